"""Spelling variants: words that differ by one inserted, deleted or replaced character, by rolling hashes of deletions.

Words are counted in tasks (each task adds up its own first) and then by Spark.  Every word gives one key for each character that
can be left out, made from polynomial hashes of all its prefixes and suffixes, so a key costs one multiplication whatever the
word's length; NumPy makes them for whole batches.  Two words of one length that agree in (key, place) are a replacement apart; a
word whose own hash is another's key is an insertion apart.  Keys are dealt to tasks by their leading bits and sorted there as
integers; words under one key are compared as strings, with the character left out, before they count as near.

Keys carry a hash of their word; only those that meet another word's fetch the words themselves.  A row of equal letters gives one key
with the places of the row, as any of them leaves the same behind.  So a word of m characters costs at most m rows of 28 bytes,
and in its task some 50 bytes a character.

Nothing is written a pair.  Words that agree in what is left and the place of the gap differ in one character only, so there are at
most as many as the alphabet has letters (96 with the default pattern), and each of them needs only their number and the two
most frequent.  The same holds for a whole word and its insertions, of which there are at most 96 a place.

A word's form is the most frequent near word, if frequent enough; roots follow forms, doubling their reach each round.  Counts
grow by ``ratio`` a step, so there are at most log2(log10(rows)) + 1 rounds.

Defined cases: null and empty texts have no words; a null doc_id counts as the empty string; rows with one id are read each; words
of any length are taken whole; of forms equally frequent the first in code-point order counts; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, forget, mix64, released, sliced, stored, table, text_bytes

MIN_CHARS, MIN_COUNT, RATIO, EVERY = 7, 2, 10, 31
HELD_WORDS = 100_000
RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that no power of it vanishes modulo 2**64


def _counted(totals: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], ["word", "n"])


def words(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """word, n, and the word's hash ``wid``: the distinct words of MIN_CHARS characters that occur MIN_COUNT times.

    Of a word in a document whose crc32 is divisible by ``every``, one character is left out (0: of none)."""
    run = re.compile(RUN.pattern.replace("+", f"{{{MIN_CHARS},}}"))  # shorter runs give no word

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()
        held = 0
        for whole in batches:
            for batch in sliced(whole, "text"):
                for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                    seed = zlib.crc32(f"{id_}:".encode())
                    for word, n in Counter(run.findall(text.translate(LOWER).decode())).items():
                        h = zlib.crc32(word.encode(), seed)
                        if every and h % every == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                            if len(word) < MIN_CHARS:
                                continue
                        totals[word] += n
                        held += len(word) if totals[word] == n else 0
                if len(totals) > HELD_WORDS or held > 64 * HELD_WORDS:
                    yield _counted(totals)
                    totals, held = Counter(), 0
        yield _counted(totals)

    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")
    counts = docs.select(ids, text_bytes().alias("text")).mapInArrow(released(count), "word string, n long")
    counts = counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)
    return stored(counts.withColumn("wid", F.xxhash64("word")), "spelling-words")


def deletion_keys(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(number of the word, key, first place, place behind the last) for each word and each row of equal letters in it, of which one
    is left out, and for each word itself, with places -1."""
    sizes = np.array([len(t) for t in texts], np.int64)
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    starts = np.cumsum(sizes) - sizes
    local = np.arange(len(letters)) - starts[owner]
    power = np.ones(int(sizes.max(initial=0)) + 1, np.uint64)
    power[1:] = BASE
    power = np.cumprod(power)
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    # prefix hashes are sums from a word's start, suffix hashes what is left of its whole sum
    total = np.r_[np.uint64(0), np.cumsum(mix64(letters + BASE) * power[local])]
    first = np.flatnonzero((local == 0) | (letters != np.r_[np.uint64(0), letters[:-1]]))
    length = np.diff(first, append=len(letters))
    word = owner[first]
    begin, end = starts[word], starts[word] + sizes[word]
    gap = (total[first] - total[begin]) + (total[end] - total[first + 1]) * inverse
    whole = total[starts + sizes] - total[starts]
    sum_ = np.concatenate([gap, whole])
    left = np.concatenate([sizes[word] - 1, sizes])
    key = mix64(sum_ ^ mix64(left.astype(np.uint64) + np.uint64(1)))
    at, none = local[first], np.full(len(texts), -1)
    return np.r_[word, np.arange(len(texts))], key.view(np.int64), np.r_[at, none], np.r_[at + length, none]


def keys_of(counted: DataFrame) -> DataFrame:
    """key, wid, low, high: one row a key of each word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "raw"):
                word, key, low, high = deletion_keys([x.decode() for x in batch.column("raw").to_pylist()])
                wid = np.asarray(batch.column("wid"))[word]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(wid), pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["key", "wid", "low", "high"])

    return counted.select("wid", F.col("word").cast("binary").alias("raw")).mapInArrow(released(run), "key long, wid long, low int, high int")


def by_radix(df: DataFrame, *then: str) -> DataFrame:
    """Rows dealt by the leading bits of their keys, and sorted by key in each task."""
    return df.repartition(F.shiftrightunsigned("key", 48)).sortWithinPartitions("key", *then)


def whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches as tables that never cut the rows of a key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column("key"))
        cut = int(np.searchsorted(key, key[-1]))
        if held and (cut or held[-1].column("key")[-1].as_py() != key[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def meeting(keys: DataFrame) -> DataFrame:
    """The rows of keys under which words of two hashes or more stand."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches):
            key, wid = (group.column(c).to_numpy() for c in ("key", "wid"))
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(start, append=len(key))
            met = np.repeat(wid[start] != wid[start + size - 1], size)  # wid ascends under a key
            yield from group.filter(pa.array(met)).combine_chunks().to_batches()

    return by_radix(keys, "wid").mapInArrow(released(run), keys.schema)


def best_others(members: list[tuple[int, str]]) -> Iterator[tuple[str, int, tuple[int, str]]]:
    """Of (n, word) members that are all near each other: each word, the number of others, and the first of these."""
    first, second = sorted(members, key=lambda m: (-m[0], m[1]))[:2]
    for m in members:
        yield m[1], len(members) - 1, second if m == first else first


def near_in(group: list[tuple[str, int, int, int]]) -> Iterator[tuple[str, int, tuple[int, str]]]:
    """Of (word, n, low, high) rows under one key: words with the number of near words found here, and the best of these."""
    under: dict[str, list] = {}
    for word, n, low, high in group:
        under.setdefault(word if low < 0 else word[:low] + word[low + 1 :], []).append((word, n, low, high))
    for rows in under.values():
        if len(rows) < 2:
            continue
        at: dict[int, list[tuple[int, str]]] = {}
        for word, n, low, high in rows:
            for place in range(low, high):
                at.setdefault(place, []).append((n, word))
        for members in at.values():
            if len(members) > 1:
                yield from best_others(members)
        for word, n, low, _ in rows:
            if low < 0:
                longer = [(m, w) for w, m, p, _ in rows if p >= 0]
                if longer:
                    yield word, len(longer), min(longer, key=lambda m: (-m[0], m[1]))
                    yield from ((w, 1, (n, word)) for _, w in longer)


def near(counted: DataFrame) -> DataFrame:
    """word, n_near, form_n, form: number and best of the near words of each word that has any."""
    met = stored(meeting(keys_of(counted)), "spelling-keys")
    members = met.join(counted, "wid").select("key", "word", "n", "low", "high")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches):
            key = group.column("key").to_numpy()
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).tolist()
            rows = list(zip(*(group.column(c).to_pylist() for c in ("word", "n", "low", "high"))))
            found = [x for a, b in zip(start, [*start[1:], len(rows)]) for x in near_in(rows[a:b])]
            yield pa.RecordBatch.from_arrays([
                pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64()),
                pa.array([f[2][0] for f in found], pa.int64()), pa.array([f[2][1] for f in found], pa.string()),
            ], ["word", "met", "m", "other"])

    found = by_radix(members).mapInArrow(released(run), "word string, met long, m long, other string")
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("other")))
    found = found.groupBy("word").agg(F.sum("met").alias("n_near"), best.alias("best"))
    out = stored(found.select("word", "n_near", (-F.col("best.m")).alias("form_n"), F.col("best.other").alias("form")), "spelling-near")
    forget(met)
    return out


def variants(docs: DataFrame, ratio: int = RATIO, every: int = EVERY) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words."""
    bounded_batches(docs.sparkSession)
    counted = words(docs, every)
    found = near(counted)
    fits = F.col("form_n") >= ratio * F.col("n")
    rows = counted.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(fits, F.col(c)).alias(c) for c in ("form", "form_n")]
    )
    rows = stored(rows, "spelling-forms")
    forget(counted, found)
    up = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = stored(up.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        if after.where("moved").isEmpty():
            break
        if hasattr(up, "stored_path"):
            forget(up)
        path = after.stored_path
        up = after.drop("moved")
        up.stored_path = path
    out = rows.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = stored(out, "spelling-variants")
    forget(rows, after, *([up] if hasattr(up, "stored_path") else []))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: crc32 by its table of 256 remainders; near words by what deletions leave.
ORACLE_SQL = """WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, run, count(*) AS c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x
    FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT run, c, xor(list_reduce(list_concat([4294967295], list_transform(range(CAST(length(x) / 2 AS BIGINT)),
    lambda i: CAST(16 * (instr('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1)
        + instr('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1 AS BIGINT))),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS h FROM runs, crc),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT c, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run))
    || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
gaps AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS s
    FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
    UNION SELECT g.word, w.word, w.n FROM gaps g JOIN w ON g.s = w.word
    UNION SELECT w.word, g.word, g.n FROM gaps g JOIN w ON g.s = w.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n,
    CASE WHEN b.m >= 10 * w.n THEN (SELECT min(p.other) FROM pairs p WHERE p.word = w.word AND p.m = b.m) END AS form
    FROM w LEFT JOIN best b USING (word)),
chain AS (SELECT word, word AS at, form AS up FROM forms
    UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.up)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.up IS NULL"""
