"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents inside a task.  Its words become symbols, an FM-index (suffix array, BWT in a wavelet
matrix, sampled suffix positions) is built over them, all windows of the benchmark are searched backwards at once,
their occurrences located from the samples, and the covered words merged to spans for removal.

Before that, words that cannot lie in any occurrence are left out: a window of two words or more needs each pair of
neighbours to be a pair of neighbours of some window.  This loses no occurrence, and clean shards index nothing
(``whole=True`` indexes all words).

The benchmark is the stated query set.  Spark cuts it into different windows with their items.  Windows are dealt by
hash into blocks of about ``BLOCK_WINDOWS``, the size bound of what is broadcast.  Where there are several, one pass over the
documents first cuts out runs of words that may lie in an occurrence, by a bitmap of fixed size over the hashes of all
windows' neighbouring pairs, which loses none; each block is searched in these runs only, its spans are written, and its
broadcast goes before the next.  So texts are gone over twice, for the runs and for the result, at any number of windows.
Windows that are found are joined with their items by key.

Defined cases: null texts and texts without words are never contaminated; items without words are ignored; repeated
items count once per item_id, a null item_id as the empty string; repeated document rows are each searched; an empty
table on either side gives rows without hits or no rows.  Input columns other than ``text`` and ``n_chars`` pass through
untouched, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BITS, WORD_BYTES, bitmap, carried, forget, mix64, released, sliced, stored, table, text_bytes, top_bits, with_text
from .neardup import word_hashes

WINDOW, BLOCK_WINDOWS, SHARD_BYTES, SAMPLE, BITMAP_BITS = 10, 200_000, 2 << 20, 8, 22
#: A word in UTF-8 bytes, see WORD_BYTES.
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class Patterns:
    """A block of windows (words with spaces between): symbols from 2 (0 ends a text, 1 parts runs), windows by length,
    and neighbouring pairs."""

    def __init__(self, windows: Iterable[bytes]):
        self.symbols: dict[bytes, int] = {}
        by_length: dict[int, list[tuple[list[int], bytes]]] = {}
        pairs, self.single = set(), set()
        for window in windows:
            codes = [self.symbols.setdefault(w, len(self.symbols) + 2) for w in window.split()]
            by_length.setdefault(len(codes), []).append((codes, window))
            pairs.update(zip(codes, codes[1:]))
            if len(codes) == 1:
                self.single.add(codes[0])
        self.size = len(self.symbols) + 2
        self.by_length = {
            m: (np.array([c for c, _ in rows], np.int64), [w for _, w in rows])
            for m, rows in by_length.items()
        }
        self.shortest = min((m for m in by_length if m > 1), default=0)
        self.pairs = np.sort(np.array([a * self.size + b for a, b in pairs], np.int64))
        self.bitmap = np.zeros(1 << BITMAP_BITS, bool)
        self.bitmap[self.hashed(self.pairs)] = True

    @staticmethod
    def hashed(codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITMAP_BITS)

    def kept(self, symbols: np.ndarray) -> np.ndarray:
        """Which words may lie in an occurrence."""
        keep = np.zeros(len(symbols), bool)
        if self.shortest and len(symbols) > 1:
            codes = symbols[:-1] * self.size + symbols[1:]
            at = np.flatnonzero(self.bitmap[self.hashed(codes)] & (symbols[:-1] > 0) & (symbols[1:] > 0))
            found = np.minimum(np.searchsorted(self.pairs, codes[at]), len(self.pairs) - 1)
            at = at[self.pairs[found] == codes[at]]
            if len(at):
                cuts = np.flatnonzero(np.diff(at) != 1) + 1
                first, last = at[np.r_[0, cuts]], at[np.r_[cuts - 1, len(at) - 1]] + 1
                long = last - first + 1 >= self.shortest
                edge = np.zeros(len(symbols) + 1, np.int32)
                np.add.at(edge, first[long], 1)
                np.add.at(edge, last[long] + 1, -1)
                keep = np.cumsum(edge[:-1]) > 0
        if self.single:
            keep |= np.isin(symbols, list(self.single))
        return keep


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling."""
    n, step = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        pair = rank * (n + 2) + after
        order = np.argsort(pair, kind="stable")
        new = np.cumsum(np.r_[0, np.diff(pair[order]) != 0])
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, a level per bit."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.zeros, self.ones = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = symbols >> level & 1
            self.ones.append(np.r_[0, np.cumsum(bit)])
            self.zeros.append(len(bit) - int(bit.sum()))
            symbols = np.r_[symbols[bit == 0], symbols[bit == 1]]

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        first, last = np.zeros_like(upto), upto
        for level, zeros, ones in zip(range(self.bits - 1, -1, -1), self.zeros, self.ones):
            bit = symbol >> level & 1
            f, l = ones[first], ones[last]
            first, last = np.where(bit, zeros + f, first - f), np.where(bit, zeros + l, last - l)
        return last - first


class FMIndex:
    def __init__(self, text: np.ndarray, size: int):
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=size))]
        self.tree = WaveletMatrix(self.bwt, size)
        self.sampled = order % SAMPLE == 0
        self.samples = order[self.sampled]
        self.sample_at = np.cumsum(self.sampled) - 1

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the patterns that occur, and their rows in the suffix order as half-open ranges."""
        which, last = np.arange(len(patterns)), patterns[:, -1]
        lo, hi = self.before[last], self.before[last + 1]
        for j in range(patterns.shape[1] - 2, -1, -1):
            live = lo < hi
            which, lo, hi = which[live], lo[live], hi[live]
            c = patterns[which, j]
            lo, hi = self.before[c] + self.tree.rank(c, lo), self.before[c] + self.tree.rank(c, hi)
        live = lo < hi
        return which[live], lo[live], hi[live]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled one."""
        places, steps, open_ = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(open_):
            known = self.sampled[rows]
            places[open_[known]] = self.samples[self.sample_at[rows[known]]] + steps
            open_, rows = open_[~known], rows[~known]
            c = self.bwt[rows]
            rows, steps = self.before[c] + self.tree.rank(c, rows), steps + 1
        return places


def occurrences(symbols: np.ndarray, patterns: Patterns, whole: bool = False) -> Iterator[tuple[int, int, int]]:
    """(length, window, places) of all windows in a shard's symbols."""
    keep = np.ones(len(symbols), bool) if whole else patterns.kept(symbols)
    if not keep.any():
        return
    # runs of kept words with a mark between them, and the end
    at = np.flatnonzero(keep)
    gaps = np.flatnonzero(np.diff(at) != 1) + 1
    text, place = np.insert(np.maximum(symbols[at], 1), gaps, 1), np.insert(at, gaps, -1)
    index = FMIndex(np.r_[text, 0], patterns.size)
    for length, (windows, _) in patterns.by_length.items():
        which, lo, hi = index.search(windows)
        if len(which):
            n = hi - lo
            rows = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield length, np.repeat(which, n), place[index.locate(rows)]


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """window (words with spaces between), item: different rows, stored."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows, items = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                found = {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else ()
                windows.extend(found)
                items.extend([item or ""] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(items, pa.string())], ["window", "item"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), text_bytes().alias("text"))
    return stored(items.mapInArrow(released(cut), "window binary, item string").distinct(), "benchmark-windows")


def neighbours(h: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of neighbouring words, from the words' hashes."""
    return mix64(h[:-1] * np.uint64(3) + h[1:])


def alone(h: np.ndarray) -> np.ndarray:
    """Hashes of words as windows of one word."""
    return mix64(h ^ np.uint64(0x9E3779B97F4A7C15))


def runs_of(rows: DataFrame, different: DataFrame) -> DataFrame:
    """row_id, at (the first word's place), text (words with spaces between) of the runs of words in rows (row_id, text) that
    may lie in an occurrence of any of the windows (window): runs whose neighbours are all neighbours in some window, and
    which are no shorter than the shortest window, and words that are windows."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            words = [w.split() for w in batch.column(0).to_pylist()]
            hashes = [word_hashes(w, known) for w in words]
            keys = np.concatenate([np.zeros(0, np.uint64), *[alone(h) if len(h) == 1 else neighbours(h) for h in hashes]])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(keys).view(np.int64))], ["h"])

    # of the windows of two words or more
    length = F.size(F.split(F.col("window").cast("string"), " "))
    shortest = different.agg(F.min(F.when(length > 1, length))).first()[0] or 0
    keys = different.select("window").mapInArrow(released(hashed), "h long")
    held = rows.sparkSession.sparkContext.broadcast(bitmap(keys, top_bits("h")))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        bits = np.frombuffer(held.value, np.uint8)

        def among(keys: np.ndarray) -> np.ndarray:
            at = keys >> np.uint64(64 - BITS)
            return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

        for whole_batch in batches:
            for batch in sliced(whole_batch, "text", SHARD_BYTES):
                ids, places, texts = [], [], []
                for row_id, text in zip(batch.column("row_id").to_pylist(), batch.column("text").to_pylist()):
                    words = words_of(text)
                    if not words:
                        continue
                    h = word_hashes(words, known)
                    keep = among(alone(h))
                    for first, last in stretches(among(neighbours(h))):
                        if last - first + 1 >= shortest > 0:  # a pair more is a word more
                            keep[first : last + 1] = True
                    for first, last in stretches(keep):
                        ids.append(row_id)
                        places.append(first)
                        texts.append(b" ".join(words[first:last]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(texts, pa.binary())], ["row_id", "at", "text"]
                )

    out = rows.select("row_id", "text").mapInArrow(released(cut), "row_id long, at long, text binary")
    out.held = held
    return out


def stretches(mask: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of true values as half-open ranges."""
    turn = np.diff(np.r_[0, mask.view(np.int8), 0])
    return list(zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()))


SPAN = T.StructType([T.StructField("first", T.LongType()), T.StructField("words", T.LongType())])
FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(SPAN)),
    T.StructField("windows", T.ArrayType(T.BinaryType())),
    T.StructField("clean", T.StringType()),
]
SPANS = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))


def without(raw: bytes, spans: list[dict]) -> str:
    """The text without spans of its words."""
    place = [m.span() for m in WORD.finditer(raw)]
    kept, at = [], 0
    for s in spans:
        kept.append(raw[at : place[s["first"]][0]])
        at = place[s["first"] + s["words"] - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def search(rows: DataFrame, patterns: Patterns, remove: bool, whole: bool) -> DataFrame:
    """FOUND for rows (..., text): words, merged spans of hit words, windows found and, with remove, the text without
    hit words where there are some.  The columns beside the text stay."""
    held = rows.sparkSession.sparkContext.broadcast(patterns)
    beside = [c for c in rows.columns if c != "text"]

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = held.value
        for whole_batch in batches:
            for batch in sliced(whole_batch, "text", SHARD_BYTES):
                texts = batch.column("text").to_pylist()
                words = [words_of(t) for t in texts]
                sizes = np.array([len(w) for w in words], np.int64)
                starts = np.r_[0, np.cumsum(sizes + 1)]
                found: list[set[bytes]] = [set() for _ in words]
                edge, symbols = np.zeros(starts[-1] + 1, np.int64), np.zeros(starts[-1], np.int64)
                for s, w in zip(starts, words):
                    symbols[s : s + len(w)] = np.fromiter(map(patterns.symbols.get, w, repeat(0)), np.int64, len(w))
                for length, which, places in occurrences(symbols, patterns, whole):
                    np.add.at(edge, places, 1)
                    np.add.at(edge, places + length, -1)
                    row = np.searchsorted(starts, places, side="right") - 1
                    for r, k in np.unique(np.c_[row, which], axis=0).tolist():
                        found[r].add(patterns.by_length[length][1][k])
                hit = np.cumsum(edge[:-1]) > 0
                turn = np.diff(np.r_[0, hit.view(np.int8), 0])
                first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
                row = np.searchsorted(starts, first, side="right") - 1
                spans: list[list[dict]] = [[] for _ in words]
                for r, f, l in zip(row.tolist(), first.tolist(), last.tolist()):
                    spans[r].append({"first": f - int(starts[r]), "words": l - f})
                clean = [without(t, s) if s and remove else None for t, s in zip(texts, spans)]
                new = [pa.array(sizes), pa.array(spans, SPANS), pa.array([sorted(x) for x in found], pa.list_(pa.binary())), pa.array(clean, pa.string())]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in beside], *new], [*beside, *[f.name for f in FOUND]])

    out = rows.mapInArrow(released(find), T.StructType([*[rows.schema[c] for c in beside], *FOUND]))
    out.held = held
    return out


def united(rows: DataFrame, parts: list[DataFrame], remove: bool) -> DataFrame:
    """FOUND for rows (row_id, row, text) from the stored parts (row_id, spans, windows) of several blocks."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    both = both.groupBy("row_id").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("windows")))).alias("windows")
    )

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, clean = [], [], []
            for text, parted in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                sizes.append(len(words_of(text)))
                one: list[dict] = []
                for s in parted or ():
                    if one and s["first"] <= one[-1]["first"] + one[-1]["words"]:
                        one[-1]["words"] = max(one[-1]["words"], s["first"] + s["words"] - one[-1]["first"])
                    else:
                        one.append(dict(s))
                spans.append(one)
                clean.append(without(text, one) if one and remove else None)
            new = [pa.array(sizes, pa.int64()), pa.array(spans, SPANS), batch.column("windows"), pa.array(clean, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("row"), *new], ["row_id", "row", *[f.name for f in FOUND]])

    none = F.array().cast("array<binary>")
    joined = rows.join(both, "row_id", "left").select("row_id", "row", "text", "spans", F.coalesce("windows", none).alias("windows"))
    return joined.mapInArrow(released(finish), T.StructType([rows.schema["row_id"], rows.schema["row"], *FOUND]))


def annotate(
    docs: DataFrame,
    windows: DataFrame,
    block_windows: int = BLOCK_WINDOWS,
    remove: bool = False,
    whole: bool = False,
) -> DataFrame:
    """row_id, row (a struct of the input columns) and FOUND; windows: of windows_of."""
    different = windows.select("window").distinct()
    blocks = max(1, -(-different.count() // block_windows))
    rows = carried(docs).withColumn("row_id", F.monotonically_increasing_id()).select("row_id", "row", "text")
    if blocks == 1:
        # at most block_windows rows
        return search(rows, Patterns([bytes(r[0]) for r in different.toLocalIterator()]), remove, whole)
    rows, parts = stored(rows, "decontamination-rows"), []
    if whole:
        runs = rows.select("row_id", F.lit(0).cast("long").alias("at"), "text")
    else:
        cut = runs_of(rows, different)
        runs = stored(cut, "decontamination-runs")
        cut.held.destroy()
    place = F.transform("spans", lambda s: F.struct((s["first"] + F.col("at")).alias("first"), s["words"].alias("words")))
    for b in range(blocks):
        block = different.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b)
        found = search(runs, Patterns([bytes(r[0]) for r in block.toLocalIterator()]), False, whole)
        parts.append(stored(found.where("size(spans) > 0").select("row_id", place.alias("spans"), "windows"), "decontamination-spans"))
        found.held.destroy()  # its matches are written
    if not whole:
        forget(runs)
    return united(rows, parts, remove)


def items_of(found: DataFrame, windows: DataFrame) -> DataFrame:
    """row_id, items: sorted, of found rows (row_id, windows) with a window."""
    each = found.select("row_id", F.explode("windows").alias("window")).join(windows, "window")
    return each.groupBy("row_id").agg(F.array_sort(F.collect_set("item")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents without the words of benchmark passages; n_chars, where present, follows the text."""
    found = annotate(docs, windows_of(benchmark, window), block_windows, remove=True)
    return with_text(found, F.coalesce("clean", "row.text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    windows = windows_of(table(spark, sf_dir, "benchmark"))
    found = annotate(docs, windows).select("row_id", "row.doc_id", "n_words", "spans", "windows")
    found = stored(found, "decontamination-found")
    # only rows with a window meet the items
    none = found.where("size(windows) = 0").withColumn("items", F.array().cast("array<string>"))
    items = found.where("size(windows) > 0").join(items_of(found, windows), "row_id").unionByName(none)
    hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"]), F.lit(0))
    return items.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
    FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS u(i) WHERE len(w) > 0),
pos AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t
    FROM w, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) AS u(i)),
found AS (SELECT DISTINCT doc_id, i, pos.n, item_id FROM pos JOIN win ON pos.n = win.n AND pos.t = win.t),
hits AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, n)) AS u(k) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
