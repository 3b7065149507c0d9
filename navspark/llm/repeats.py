"""Removal of repeated byte strings: prefix doubling over the positions that anchors and cells leave open.

The question is that of a suffix array: which positions share their next THRESHOLD bytes with another position.  Ranks
(names of classes of equal strings) are refined at growing lengths, and positions that become unique leave.  Two steps
before the doubling keep it small without losing a match:

* Anchors.  Each window of THRESHOLD bytes picks its smallest GRAM-byte string (by hash) as anchor; equal windows pick
  the same one at the same distance.  So only anchors, about one in 75 bytes, are grouped first; windows of an anchor
  whose gram is unique are unique.
* Cells.  An anchor stands for the run of windows that picked it.  Runs with equal text are one class: repeated as a
  whole.  Runs that share the gram but not the text are split by distance from the anchor into cells of 40, 8, then 2
  windows; a cell that is alone with the string common to its windows (161, 193, 199 bytes) is unique, one whose full
  text comes twice is repeated, and only others go on.
* Doubling.  The windows of the cells left are positions, ranked among those at the same distance from the same gram.
  From ranks of strings of a quarter of THRESHOLD, Spark groups the pairs (rank here, rank an offset on) to ranks of half
  and then of all THRESHOLD bytes: offsets 50 and 100.  A position alone with its pair leaves at once; one that keeps
  company to the last is repeated.

Helpers in tasks find anchors; everything else is grouping and joins.  Filters that are broadcast are bitmaps of fixed
size and only save work: what they let through by chance is dropped by the exact grouping.  Spans are joined to texts
by md5 of the text.

Strings are told apart by pairs of 64-bit hashes (gram and run, gram and cell, gram and rank pair), never by one alone:
among 10^12 anchors two different ones agree in both with a probability of about 10^-15, for texts that are not built
against the hash.

Defined cases: a null text is empty; texts under THRESHOLD bytes lose nothing; equal rows are removed whole, as each
has its strings elsewhere; an empty table gives no row; input columns pass through ``remove``, whatever their names, and
it leaves characters whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BITS, bitmap, carried, flat, forget, likely, mix64, released, sliced, stored, table, text_bytes, top_bits, with_text

THRESHOLD, GRAM, CELLS = 200, 48, (40, 8, 2)
#: Bytes of text whose anchors are found at once: about 25 arrays of eight bytes each.
SLICE = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A pseudo-random odd number for each byte.
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(max(n, 2 * SLICE), base, np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts after each other: text number, first window (in raw), windows, distance of the anchor from the first
    window, hash of the gram, hash of the text of all windows."""
    n, window = len(raw), THRESHOLD - GRAM + 1
    if n < THRESHOLD:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    up = powers(_BASE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[raw] * powers(_INVERSE, n), out=sums[1:])
    grams = mix64((sums[GRAM:] - sums[:-GRAM]) * up[: n - GRAM + 1])
    low = np.uint64((1 << int(n).bit_length()) - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)  # the leftmost of equal ones
    # sliding minimum from block-wise prefix and suffix minima
    padded = np.concatenate([key, np.full(-len(key) % window, 2**64 - 1, np.uint64)]).reshape(-1, window)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - THRESHOLD + 1
    at = (np.minimum(after[:windows], before[window - 1 : window - 1 + windows]) & low).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.flatnonzero(row[:windows] == row[THRESHOLD - 1 :])
    if not len(inside):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    at, of = at[inside], row[inside]
    cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(of) != 0)) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(at)] - 1
    lo, hi = inside[first], inside[last]
    count = hi - lo + 1
    run = mix64((sums[hi + THRESHOLD] - sums[lo]) * up[lo] + count.astype(np.uint64))
    return of[first], lo, count, at[first] - lo, grams[at[first]], run


def marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(64 - BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def grams(docs: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text", SLICE):
                gram = anchors(*flat(batch.column("text")))[4]
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64))], ["gram"])

    return docs.select(text_bytes().alias("text")).mapInArrow(released(run), "gram long")


def runs(docs: DataFrame, held_grams) -> DataFrame:
    """Text key, place and classes of the runs whose gram may be repeated; dhi and dlo: most and least distance of the
    anchor from a window of the run."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held_grams.value, np.uint8)
        for whole in batches:
            for batch in sliced(whole, "text", SLICE):
                raw, offsets = flat(batch.column("text"))
                of, lo, n, d, gram, text = anchors(raw, offsets)
                keep = marked(bits, gram)
                of, lo, n, d, gram, text = (x[keep] for x in (of, lo, n, d, gram, text))
                keys = {i: hashlib.md5(raw[offsets[i] : offsets[i + 1]]).digest() for i in np.unique(of).tolist()}
                cols = [
                    pa.array([keys[i] for i in of.tolist()], pa.binary()), pa.array((lo - offsets[of]).astype(np.int32)),
                    pa.array((d - n + 1).astype(np.int32)), pa.array(d.astype(np.int32)),
                    pa.array(gram.view(np.int64)), pa.array(text.view(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["key", "lo", "dlo", "dhi", "gram", "run"])

    return docs.select(text_bytes().alias("text")).mapInArrow(
        released(run), "key binary, lo int, dlo int, dhi int, gram long, run long"
    )


def texts(docs: DataFrame, held_runs) -> DataFrame:
    """gram, run, text of the runs that may be wanted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held_runs.value, np.uint8)
        for whole in batches:
            for batch in sliced(whole, "text", SLICE):
                raw, offsets = flat(batch.column("text"))
                _, lo, n, _, gram, text = anchors(raw, offsets)
                keep = marked(bits, text)
                found: dict[tuple[int, int], bytes] = {}
                for g, t, a, b in zip(*(x[keep].tolist() for x in (gram.view(np.int64), text.view(np.int64), lo, lo + n))):
                    if (g, t) not in found:
                        found[g, t] = raw[a : b + THRESHOLD - 1].tobytes()
                cols = [pa.array([k[i] for k in found], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(found.values(), pa.binary())], ["gram", "run", "text"])

    return docs.select(text_bytes().alias("text")).mapInArrow(released(run), "gram long, run long, text binary")


def split(rows: DataFrame, size: int) -> DataFrame:
    """Runs (gram, run, m, done, dlo, dhi, text) to their cells of ``size`` distances, with the ranks of the string
    common to a cell's windows and of the text of the windows here."""
    cells = F.sequence(F.floor(F.col("dlo") / size).cast("int"), F.floor(F.col("dhi") / size).cast("int"))
    lo, hi = F.greatest("dlo", F.col("cell") * size), F.least("dhi", F.col("cell") * size + size - 1)
    cut = rows.withColumn("cell", F.explode(cells)).select(
        "gram", "run", "m", "done", "cell", lo.alias("dlo"), hi.alias("dhi"),
        F.substring("text", F.col("dhi") - hi + 1, hi - lo + THRESHOLD).alias("text"),
    )
    common = F.substring("text", F.col("dhi") - F.col("cell") * size + 1, F.lit(THRESHOLD - size + 1))
    return cut.withColumns({"common": F.xxhash64(common), "whole": F.xxhash64("dlo", "dhi", "text")})


def positions(rows: DataFrame) -> DataFrame:
    """The windows of cells (see split) at their distance d, with ranks of their four quarters."""
    quarter = THRESHOLD // 4
    each = rows.select("gram", "run", "m", "done", "dhi", "text", F.explode(F.sequence("dlo", "dhi")).alias("d"))
    rank = lambda k: F.xxhash64(F.substring("text", F.col("dhi") - F.col("d") + 1 + k * quarter, F.lit(quarter)))
    return each.select("gram", "d", "run", "m", "done", *[rank(k).alias(f"rank{k * quarter}") for k in range(4)])


def doubled(rows: DataFrame, here: str, there: str, rank: str) -> DataFrame:
    """Ranks of strings twice as long from pairs of ranks, here and an offset on; positions alone with their pair leave."""
    pair = ["gram", "d", here, there]
    # a run has one window at a distance, so its smallest run names a class
    names = rows.groupBy(pair).agg(F.min("run").alias(rank), F.sum("m").alias("n")).where("n > 1").drop("n")
    return rows.join(names, pair).drop(here, there)


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The runs (see runs()), their repeated distances (gram, run, dlo, dhi), and the stored tables behind both."""
    context = docs.sparkSession.sparkContext
    twice = grams(docs).groupBy("gram").count().where("count > 1")
    held = context.broadcast(bitmap(twice, top_bits("gram")))
    found = stored(runs(docs, held), "repeat-runs")
    held.destroy()
    kinds = found.groupBy("gram", "run").agg(F.count("*").alias("m"), F.min("dlo").alias("dlo"), F.max("dhi").alias("dhi"))
    kinds = stored(kinds, "repeat-kinds")
    mixed = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1").select("gram")
    # runs that come twice are repeated as they are, and stay as witnesses for others with their gram
    out = [kinds.where("m > 1").select("gram", "run", "dlo", "dhi")]
    tables = [found, kinds]
    open_ = stored(kinds.join(mixed, "gram"), "repeat-mixed")
    held = context.broadcast(bitmap(open_, top_bits("run")))
    wanted = texts(docs, held).groupBy("gram", "run").agg(F.first("text").alias("text"))
    rows = open_.withColumn("done", F.col("m") > 1).join(wanted, ["gram", "run"])
    before = open_
    for size in CELLS:
        rows = stored(split(rows, size), "repeat-cells")
        forget(before)
        if size == CELLS[0]:  # the texts are stored
            held.destroy()
        before = rows
        ranks = rows.select("gram", "run", "cell", "dlo", "dhi", "m", "done", "common", "whole")
        by_common = ranks.groupBy("gram", "cell", "common").agg(
            (F.min("whole") != F.max("whole")).alias("differ"), F.sum("m").alias("of_common")
        )
        judged = ranks.join(by_common, ["gram", "cell", "common"]).where("of_common > 1")
        by_whole = judged.groupBy("gram", "cell", "whole").agg(F.sum("m").alias("of_whole"))
        judged = judged.join(by_whole, ["gram", "cell", "whole"]).withColumn("hit", F.col("of_whole") > 1)
        judged = stored(judged, "repeat-judged")
        tables.append(judged)
        out.append(judged.where("hit and not done").select("gram", "run", "dlo", "dhi"))
        # needed: cells with different texts of which some are not known to be repeated
        some = judged.groupBy("gram", "cell", "common").agg(F.min("hit").alias("all_hit"))
        again = judged.where("differ").join(some.where("not all_hit"), ["gram", "cell", "common"])
        again = again.select("gram", "run", "cell", (F.col("done") | F.col("hit")).alias("done_now"))
        cell = F.xxhash64("gram", "run", "cell")
        rows, _ = likely(rows, cell, again.select(cell.alias("h")), "h")
        rows = rows.join(again, ["gram", "run", "cell"]).withColumn("done", F.col("done_now")).drop("done_now", "cell", "common", "whole")
    half, quarter = THRESHOLD // 2, THRESHOLD // 4
    left = stored(positions(rows), "repeat-positions")
    forget(before)
    for here, there, rank in (("rank0", f"rank{quarter}", "front"), (f"rank{half}", f"rank{half + quarter}", "back"), ("front", "back", "rank")):
        before, left = left, stored(doubled(left, here, there, rank), "repeat-positions")
        forget(before)
    tables.append(left)
    out.append(left.where("not done").select("gram", "run", F.col("d").alias("dlo"), F.col("d").alias("dhi")))
    both = out[0]
    for more in out[1:]:
        both = both.unionByName(more)
    return found, both, tables


def spans(docs: DataFrame) -> DataFrame:
    """key (md5 of a text), spans: repeated byte ranges (start, end), which may overlap."""
    found, distances, tables = repeated(docs)
    hits = found.select("key", "lo", F.col("dhi").alias("top"), "gram", "run").join(distances, ["gram", "run"])
    start = F.col("lo") + F.col("top")
    hits = hits.select("key", (start - F.col("dhi")).alias("start"), (start - F.col("dlo") + THRESHOLD).alias("end"))
    out = hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    out = stored(out, "repeat-spans")
    forget(*tables)
    return out


def merged(spans_: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans_ or ():
        if out and s["start"] <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], s["end"])
        else:
            out.append((s["start"], s["end"]))
    return out


def text_key(c: Column) -> Column:
    return F.unhex(F.md5(c))


def with_spans(docs: DataFrame) -> DataFrame:
    """row (a struct of the input columns), text (its bytes) and spans."""
    found = spans(docs)
    keyed = carried(docs).withColumn("key", text_key(F.col("text")))
    some, none = likely(keyed, F.xxhash64("key"), found.select(F.xxhash64("key").alias("h")), "h")
    empty = F.lit(None).cast(found.schema["spans"].dataType)
    return some.join(found, "key", "left").unionByName(none.withColumn("spans", empty)).drop("key")


def remove(docs: DataFrame) -> DataFrame:
    """The documents without repeated strings; n_chars, where present, follows the text."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str | None] = []
            for raw, s in zip(batch.column("text"), batch.column("spans")):
                if not s.is_valid:
                    out.append(None)
                    continue
                raw, kept, at = raw.as_py(), [], 0
                for a, b in merged(s.as_py()):
                    while a < b and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    kept.append(raw[at:a])
                    at = b
                out.append(b"".join([*kept, raw[at:]]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "clean"])

    found = with_spans(docs)
    clean = found.mapInArrow(released(cut), T.StructType([found.schema["row"], T.StructField("clean", T.StringType())]))
    return with_text(clean, F.coalesce("clean", "row.text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, s in zip(batch.column("text"), batch.column("spans")):
                raw, cut = raw.as_py(), merged(s.as_py())
                sha, at = hashlib.sha256(), 0
                for a, b in cut:
                    sha.update(raw[at:a])
                    at = b
                sha.update(raw[at:])
                rows.append((len(raw), sum(b - a for a, b in cut), len(cut), sha.hexdigest()))
            cols = list(zip(*rows)) or [()] * 4
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_spans(docs).select("row.doc_id", "text", "spans")
    return rows.mapInArrow(released(digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
