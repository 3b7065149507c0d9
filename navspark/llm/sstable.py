"""Token ids in sorted-string-table shards.

File layout of a shard (all integers little-endian):

* data blocks: zstd frames of entries ``shared u8, rest u8, key[shared:], ids u32, width * ids bytes``; a key is
  written without the prefix that it shares with the key before it in its block,
* sparse block index: per block ``last key (9 bytes), offset u64, size u32, ids before it in the shard u64``,
* Bloom filter over the keys, ten bits and seven probes a key,
* footer of fixed size, see ``FOOTER``; its last byte is the line end that Spark's text writer puts after a value.

A key is a presence byte (0 for a null id) and the id as a big-endian integer moved to the unsigned range, so
that keys sort as bytes in the order of ids, nulls first.  Shards are ordered by (part, seq).

Spark does the distribution: a range exchange orders documents over all tasks, each task cuts its sorted stream
into shards, Spark's committing writer stores one file a shard, and reading is Spark's binaryFile source.  A task
holds one block and one unfinished shard (``SHARD_BYTES``), never a partition.  After the write the footers are gathered
in a manifest (a Parquet table): a file's first and last key and the ids before it.  A scan opens each file once.

A lookup takes any number of keys as a table.  Joins with the manifest deal them to the files whose range holds them; a
task then reads of a file the footer, the index with the Bloom filter, and the blocks that the search leads to, each by its
place.  Where tasks can't open files by place (``ranged``; file systems that only Spark's readers know), files are read
whole, with the same result.

Defined cases: a null text has the end id only; repeated ids stay, each row as an entry of its own, ordered by the
text's hash; an empty table gives no shard and no row; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import mix64, new_path, released, table, text_bytes
from .tokens import default_tokenizer, encoder

BLOCK_BYTES, SHARD_BYTES = 1 << 16, 16 << 20
#: Shards whose starts are broadcast at most; more are joined.
BROADCAST_SHARDS = 1_000_000
END = (1).to_bytes(4, "little")
#: part, seq, documents, ids, end of the data, blocks, Bloom bytes, width, first and last key, magic
FOOTER = "<IIQQQIIB9s9s5s"
FOOTER_SIZE = struct.calcsize(FOOTER)
INDEX = "<9sQIQ"
INDEX_SIZE = struct.calcsize(INDEX)
MAGIC, PROBES = b"NSST1", 7


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def probes(keys: list[bytes], bits: int) -> np.ndarray:
    """Bit positions of the keys: one row of PROBES each."""
    raw = np.array([int.from_bytes(k[1:], "big") ^ (k[0] << 63) for k in keys], np.uint64)
    a, b = mix64(raw), mix64(raw ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


class ShardWriter:
    """Entries in key order to the bytes of one shard."""

    def __init__(self, part: int, seq: int, width: int, block_bytes: int = BLOCK_BYTES):
        self.part, self.seq, self.width, self.block_bytes = part, seq, width, block_bytes
        self.data, self.index, self.keys = bytearray(), [], []
        self.block, self.last, self.ids, self.block_ids = bytearray(), b"", 0, 0
        self.zstd = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        while shared < len(self.last) and self.last[shared] == key[shared]:
            shared += 1
        self.block += bytes((shared, 9 - shared)) + key[shared:] + len(ids).to_bytes(4, "little")
        self.block += ids.astype(f"<u{self.width}").tobytes()
        self.last = key
        self.keys.append(key)
        self.ids += len(ids)
        if len(self.block) >= self.block_bytes:
            self.close_block()

    def close_block(self) -> None:
        if self.block:
            frame = self.zstd.compress(bytes(self.block))
            self.index.append(struct.pack(INDEX, self.last, len(self.data), len(frame), self.block_ids))
            self.data += frame
            self.block, self.last, self.block_ids = bytearray(), b"", self.ids

    def finish(self) -> bytes:
        self.close_block()
        bits = max(64, 10 * len(self.keys) + 7 >> 3 << 3)
        bloom = np.zeros(bits, np.uint8)
        bloom[probes(self.keys, bits).ravel()] = 1
        bloom = np.packbits(bloom, bitorder="little").tobytes()
        foot = struct.pack(
            FOOTER, self.part, self.seq, len(self.keys), self.ids, len(self.data), len(self.index), len(bloom), self.width,
            self.keys[0], self.keys[-1], MAGIC,
        )
        return b"".join([bytes(self.data), *self.index, bloom, foot])


def footer(fetch: Callable[[int, int], bytes], size: int) -> tuple:
    foot = struct.unpack(FOOTER, fetch(size - FOOTER_SIZE - 1, FOOTER_SIZE))
    if foot[-1] != MAGIC:
        raise ValueError("not a shard of this format")
    return foot


class Shard:
    """A shard for reading.  ``fetch(at, n)`` gives n of its ``size`` bytes: the footer and the index with the Bloom filter
    are fetched up front, a block when it is asked for."""

    def __init__(self, fetch: Callable[[int, int], bytes], size: int):
        (self.part, self.seq, self.docs, self.n_ids, end, blocks, bloom, self.width, self.first, self.last, _) = footer(fetch, size)
        self.fetch, at = fetch, blocks * INDEX_SIZE
        tail = fetch(end, at + bloom)
        self.index = list(struct.iter_unpack(INDEX, tail[:at]))
        self.bloom = np.frombuffer(tail, np.uint8, bloom, at)

    @classmethod
    def of(cls, content: bytes) -> Shard:
        return cls(lambda at, n: content[at : at + n], len(content))

    def block(self, i: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """Keys, ids before them in the shard, and ids."""
        _, offset, size, start = self.index[i]
        raw = zstandard.ZstdDecompressor().decompress(self.fetch(offset, size))
        at, key = 0, b""
        while at < len(raw):
            shared, rest = raw[at], raw[at + 1]
            key = key[:shared] + raw[at + 2 : at + 2 + rest]
            n = int.from_bytes(raw[at + 2 + rest : at + 6 + rest], "little")
            at += 6 + rest
            yield key, start, np.frombuffer(raw, f"<u{self.width}", n, at)
            at, start = at + self.width * n, start + n

    def entries(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        if not self.first <= key <= self.last:
            return False
        at = probes([key], 8 * len(self.bloom))[0]
        return bool(np.all(self.bloom[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1))

    def find(self, key: bytes) -> list[tuple[bytes, int, np.ndarray]]:
        """Binary search in the index, then in the blocks that may hold the key."""
        if not self.may_hold(key):
            return []
        found, i = [], bisect_left(self.index, key, key=lambda x: x[0])
        while i < len(self.index):
            found += [e for e in self.block(i) if e[0] == key]
            if self.index[i][0] > key:
                break
            i += 1
        return found


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    shard_bytes: int = SHARD_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> None:
    """Tokenize whole texts, append id 1 to each, and write shards in ascending doc_id order."""
    tokenizer = tokenizer or default_tokenizer()

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        width = 2 if encode.tokenizer.get_vocab_size() <= 1 << 16 else 4
        out = None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                out = out or ShardWriter(part, seq, width, block_bytes)
                out.add(key_of(doc_id), np.frombuffer(encode(text.as_py()) + END, "<u4"))
                if len(out.data) >= shard_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([out.finish()], pa.binary())], ["shard"])
                    out, seq = None, seq + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([out.finish()], pa.binary())], ["shard"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the text writer stores a string's bytes as they are
    rows.mapInArrow(released(shards), "shard binary").select(F.col("shard").cast("string")).write.option(
        "maxRecordsPerFile", 1
    ).text(f"{path}/shards")
    manifest_of(docs.sparkSession, path).write.parquet(f"{path}/manifest")


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards")


def opened(path: str) -> pa.NativeFile:
    """A file of the shared folder for reads by place."""
    uri = re.sub("^file:/+", "file:///", re.sub("^s3[an]://", "s3://", path))
    system, name = fs.FileSystem.from_uri(quote(uri, safe="/:@"))
    return system.open_input_file(name)


def ranged(df: DataFrame) -> bool:
    """Whether tasks can open the files of df (path) by place."""
    some = df.select("path").take(1)
    try:
        for row in some:
            opened(row.path).close()
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def manifest_of(spark: SparkSession, path: str) -> DataFrame:
    """path, part, seq, docs, ids, first, last (keys), start (ids of all shards before): a two-level prefix sum, within a
    part over its shards, and over the parts (one row a task of the write)."""
    found = files(spark, path)
    by_place = ranged(found)

    def feet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, foot in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if by_place:
                    with opened(name) as f:
                        rows.append(footer(lambda at, n: f.read_at(n, at), f.size()))  # noqa: B023
                else:
                    rows.append(footer(lambda at, n: foot[at : at + n], len(foot)))  # noqa: B023
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
            keys = [pa.array([r[i] for r in rows], pa.binary()) for i in (8, 9)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, *keys], ["path", "part", "seq", "docs", "ids", "first", "last"])

    # by place, the column of contents is not touched and Spark only lists
    foot = F.lit(None).cast("binary") if by_place else F.expr(f"substring(content, -{FOOTER_SIZE + 1}, {FOOTER_SIZE + 1})")
    shards = found.select("path", foot.alias("foot")).mapInArrow(
        released(feet), "path string, part long, seq long, docs long, ids long, first binary, last binary"
    )
    parts = shards.groupBy("part").agg(F.sum("ids").alias("part_ids"))
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(running), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("part_start") + F.coalesce(F.sum("ids").over(within), F.lit(0))
    return shards.join(parts, "part").withColumn("start", start).drop("part_start")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All documents of the shards: doc_id, start (ids of all documents before), n_tokens, ids as bytes' crc32."""

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                shard = Shard.of(content.as_py())
                rows = [
                    (id_of(k), s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for k, s, ids in shard.entries()
                ]
                cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
                where = [pa.array([x] * len(rows), pa.int64()) for x in (shard.part, shard.seq)]
                yield pa.RecordBatch.from_arrays(
                    [*where, *cols], ["part", "seq", "doc_id", "before", "n_tokens", "ids_crc32"]
                )

    manifest = spark.read.parquet(f"{path}/manifest").select("part", "seq", F.col("start").alias("at"))
    if manifest.count() <= BROADCAST_SHARDS:
        manifest = F.broadcast(manifest)
    rows = files(spark, path).select("content").mapInArrow(
        released(decode), "part long, seq long, doc_id long, before long, n_tokens long, ids_crc32 long"
    )
    return rows.join(manifest, ["part", "seq"]).select(
        "doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def key_column(doc_id: Column) -> Column:
    """key_of for a column of longs."""
    digits = F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.when(doc_id.isNull(), F.lit(bytes(9))).otherwise(F.unhex(F.concat(F.lit("01"), digits)))


def lookup(spark: SparkSession, path: str, asked: DataFrame | list[int | None]) -> DataFrame:
    """doc_id and ids of the asked documents (a list, or a table with a column doc_id): a row for each of their rows."""
    if isinstance(asked, list):
        asked = spark.createDataFrame([(x,) for x in asked], "doc_id long")
    keys = asked.select(key_column(F.col("doc_id").cast("long")).alias("key")).distinct()
    manifest = spark.read.parquet(f"{path}/manifest").select("part", "path", "first", "last")
    # a row a task of the write; a key that repeats may lie on both sides of an edge
    parts = manifest.groupBy("part").agg(F.min("first").alias("low"), F.max("last").alias("high"))
    dealt = keys.join(F.broadcast(parts), F.col("key").between(F.col("low"), F.col("high"))).select("part", "key")
    dealt = dealt.join(manifest, "part").where(F.col("key").between(F.col("first"), F.col("last"))).select("path", "key")
    schema = "doc_id long, ids array<long>"

    def rows(hits: list[tuple[bytes, int, np.ndarray]]) -> pa.RecordBatch:
        ids = pa.array([ids.astype(np.int64) for _, _, ids in hits], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([id_of(k) for k, _, _ in hits], pa.int64()), ids], ["doc_id", "ids"])

    def by_place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for name, of_file in groupby(pairs, key=lambda x: x[0]):
                with opened(name) as f:
                    shard = Shard(lambda at, n: f.read_at(n, at), f.size())  # noqa: B023
                    for _, key in of_file:
                        yield rows(shard.find(key))

    def in_content(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, of_file in zip(batch.column(0), batch.column(1).to_pylist()):
                shard = Shard.of(content.as_py())
                for key in of_file:
                    yield rows(shard.find(key))

    found = files(spark, path)
    if ranged(found):
        dealt = dealt.repartition("path").sortWithinPartitions("path", "key")
        return dealt.mapInArrow(released(by_place), schema)
    dealt = dealt.groupBy("path").agg(F.collect_set("key").alias("keys"))  # at most the keys of a file
    return found.join(dealt, "path").select("content", "keys").mapInArrow(released(in_content), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "sstable")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path)
