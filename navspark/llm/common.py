"""Helpers shared by the operators: table access, shared storage and byte-level batches."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a helper turns into arrays at once; bounds a task's memory whatever Arrow batch arrives.
SLICE_BYTES = 1 << 20
BATCH_ROWS, BATCH_BYTES = 1000, 64 << 20
#: Size of the bitmaps over hashes: 2**BITS bits.
BITS = 27

#: Lower-cases A-Z and turns every ASCII byte that is neither a digit nor a letter into a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts are long rows: hand them to Python tasks in Arrow batches of BATCH_ROWS rows and BATCH_BYTES at most."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; where none is configured, a temporary one if all tasks run
    in this machine, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="navspark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder, so that a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stored tables from which nothing will be read any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def top_bits(c: str) -> Column:
    """The first BITS bits of a 64-bit hash."""
    return F.shiftrightunsigned(F.col(c), 64 - BITS)


def _parts(keys: DataFrame, bit: Column) -> DataFrame:
    bit = bit + 1  # buckets hold values from 1 on
    return keys.groupBy(F.bitmap_bucket_number(bit).alias("h_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("h_bits")
    )


def bitmap(keys: DataFrame, bit: Column) -> bytes:
    """A bitmap of 2**BITS bits with those set that occur in keys: at most 2**BITS / 8 bytes reach the driver."""
    out = bytearray(1 << BITS - 3)
    for k, v in _parts(keys, bit).toLocalIterator():
        out[(k - 1) << 12 : k << 12] = v
    return bytes(out)


def likely(
    df: DataFrame, hash_: Column, keys: DataFrame, column: str, only: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose hash may be among the keys' hashes, and the rest, by a bitmap of fixed size.

    Rows outside ``only`` are never among the first.  Only the first need a join with the keys, so only they are exchanged.
    df is a frame of an operator (see carried): no column of it is called h_bit, h_bucket, h_bits or h_in.
    """
    parts = _parts(keys, top_bits(column))
    # at most 2**BITS / 2**15 rows of 4 kB
    tested = df.withColumn("h_bit", F.shiftrightunsigned(hash_, 64 - BITS) + 1)
    tested = tested.withColumn("h_bucket", F.bitmap_bucket_number("h_bit")).join(F.broadcast(parts), "h_bucket", "left")
    place = F.bitmap_bit_position("h_bit")
    byte = F.conv(F.hex(F.substring("h_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    tested = tested.withColumn("h_in", F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)))
    if only is not None:
        tested = tested.withColumn("h_in", F.col("h_in") & only)
    out = [tested.where(c).select(*df.columns) for c in (F.col("h_in"), ~F.col("h_in"))]
    return out[0], out[1]


def released(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The task function f; when a task ends, its worker gives freed memory back, as it lives on for other tasks."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return run


def ascii_lower(c: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def text_bytes(c: str = "text") -> Column:
    """The UTF-8 bytes of a text; a null text is the empty one."""
    return F.coalesce(F.col(c).cast("binary"), F.lit(b"").cast("binary"))


def carried(docs: DataFrame) -> DataFrame:
    """row: all input columns as one struct, beside which an operator's own columns have no names to clash with; text:
    the text's bytes.  ``select("row.*")`` gives the input columns back."""
    return docs.select(F.struct("*").alias("row"), text_bytes().alias("text"))


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """The input columns of a frame with ``row``, with another text; n_chars, where present, follows it."""
    fields = docs.schema["row"].dataType.fields
    chars = F.when(text.isNotNull(), F.length(text)).otherwise(F.col("row.n_chars")) if "n_chars" in docs.schema["row"].dataType.names else None
    new = {"text": text, "n_chars": chars}
    return docs.select(*[new[f.name].cast(f.dataType).alias(f.name) if f.name in new else F.col("row").getField(f.name).alias(f.name) for f in fields])


def fold(c: str, n: int) -> Column:
    """crc32 of an id's decimal digits, modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % n


def sliced(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose binary column holds about ``limit`` bytes, one row at least."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        ends = np.cumsum(sizes[start:])
        n = max(1, int(np.searchsorted(ends, limit, side="right")))
        yield batch.slice(start, n)
        start += n


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column after each other, and the n + 1 offsets of its rows."""
    rows = [x or b"" for x in column.to_pylist()]
    offsets = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    return np.frombuffer(b"".join(rows), np.uint8), offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
