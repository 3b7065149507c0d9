"""License scan: an exact set-similarity join of text blocks with license templates.

A template of n words is scanned for in blocks of twice ``step`` words that start at multiples of ``step``, the power of
two that is at least n (and at least ``STEP``), so each place where its words stand together lies in a block.  A block
matches a template if it holds at least the threshold share of the template's different words.  The join never compares
all: words are ordered by their frequency in the whole corpus, rarest first; a match must share a word of the template's
prefix (the first ``|T| - needed + 1`` words) and of the block's, the block must have ``needed`` words at least (length
filter), and the place of the shared word in both orders must leave room for the rest (positional filter).  Candidates
are then verified.

Words outside all templates cannot be shared; they stand last in the order and count only for sizes.  Templates are a
parameter of the operator, of any length and number; their vocabulary goes to the tasks, and their side of the join is
broadcast only while it has at most ``BROADCAST_ROWS`` rows.  Blocks without any word of a template prefix, or with fewer
known words than any template of their size needs, leave no row.

Phrases are templates with threshold 1 whose places are then counted exactly: the words consecutively, in order.

Defined cases: a null text has no words; repeated rows are scanned each; ties in frequency go by the word; templates
without words match nothing; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTES, released, sliced, stored, table, text_bytes

STEP, THRESHOLD, BROADCAST_ROWS = 32, 0.8, 200_000

# Phrases with their labels, and license texts with the labels that this operator adds.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Whole public license texts, labelled by their files' names.
TEMPLATES |= {f.read_text(): f.stem for f in sorted((Path(__file__).parent / "templates").glob("*.txt"))}


def split(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> list[int]:
    """How often each template word stands in the corpus."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                words = split(text.as_py())
                codes = np.fromiter(map(vocabulary.get, words, repeat(len(vocabulary))), np.int64, len(words))
                total += np.bincount(codes, minlength=len(total))
        seen = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["word", "n"])

    counted = docs.select(text_bytes()).mapInArrow(released(count), "word long, n long").groupBy("word").agg(F.sum("n"))
    found = dict(counted.collect())  # a row a template word at most
    return [found.get(i, 0) for i in range(len(vocabulary))]


def step_of(words: int) -> int:
    return max(STEP, 1 << max(0, words - 1).bit_length())


def blocks(docs: DataFrame, codes: dict[bytes, int], prefixes: dict[int, set[int]], least: dict[int, int]) -> DataFrame:
    """doc_id, row, n_words, and the blocks with a word of some prefix: step, block, size, words (rank or -1).

    prefixes and least: by step, the words of the prefixes and the fewest known words that a match has."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = {step: np.zeros(len(codes) + 1, bool) for step in prefixes}
        for step, ranks in prefixes.items():
            rare[step][list(ranks)] = True
        kind = pa.list_(pa.struct([("step", pa.int32()), ("block", pa.int64()), ("size", pa.int32()), ("words", pa.list_(pa.int32()))]))
        for whole in batches:
            for batch in sliced(whole, "text"):
                sizes, found = [], []
                for text in batch.column("text").to_pylist():
                    words = split(text)
                    ranks = np.fromiter(map(codes.get, words, repeat(-1)), np.int32, len(words))
                    mine = []
                    for step, wanted in rare.items():
                        hits = np.flatnonzero(wanted[ranks])
                        for k in sorted(set((hits // step).tolist()) | set((hits // step - 1).tolist())):
                            part = ranks[max(0, k) * step : k * step + 2 * step]
                            known = np.unique(part)
                            if k >= 0 and len(known) - (known[0] < 0) >= least[step]:
                                size = len(set(words[k * step : k * step + 2 * step]))
                                mine.append({"step": step, "block": k, "size": size, "words": part})
                    found.append(mine)
                    sizes.append(len(words))
                cols = [batch.column("doc_id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(found, kind)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row", "n_words", "blocks"])

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text_bytes().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        released(cut), f"doc_id {kind}, row long, n_words long, blocks array<struct<step: int, block: long, size: int, words: array<int>>>"
    )


def scan(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    threshold: float = THRESHOLD,
) -> tuple[DataFrame, DataFrame]:
    """All documents (doc_id, row, n_words), and the matches: row, step, block, label, phrase, containment, places."""
    spark = docs.sparkSession
    texts = [(split(t.encode()), label, False) for t, label in templates.items()]
    texts += [(split(t.encode()), label, True) for t, label in phrases.items()]
    texts = [t for t in texts if t[0]]
    vocabulary = {w: i for i, w in enumerate(sorted({w for ws, _, _ in texts for w in ws}))}
    n = frequencies(docs, vocabulary)
    codes = {w: r for r, w in enumerate(sorted(vocabulary, key=lambda w: (n[vocabulary[w]], w)))}
    sides, prefix = [], []
    prefixes: dict[int, set[int]] = {}
    least: dict[int, int] = {}
    for k, (words, label, phrase) in enumerate(texts):
        order, step = sorted({codes[w] for w in words}), step_of(len(words))
        needed = len(order) if phrase else math.ceil(threshold * len(order) - 1e-9)
        sides.append((k, step, label, phrase, order, [codes[w] for w in words] if phrase else [], needed))
        first = order[: len(order) - needed + 1]
        prefix += [(r, step, k, i) for i, r in enumerate(first)]
        prefixes.setdefault(step, set()).update(first)
        least[step] = min(needed, least.get(step, needed))
    sides_df = spark.createDataFrame(
        sides, "template int, step int, label string, phrase boolean, tokens array<int>, sequence array<int>, needed int"
    )
    prefix_df = spark.createDataFrame(prefix, "rank int, step int, template int, i int")
    if len(prefix) <= BROADCAST_ROWS:
        sides_df, prefix_df = F.broadcast(sides_df), F.broadcast(prefix_df)
    found = stored(blocks(docs, codes, prefixes, least), "license-blocks")
    each = found.select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    each = each.withColumn("known", F.array_sort(F.filter(F.array_distinct("words"), lambda r: r >= 0)))
    probes = each.select("*", F.posexplode("known").alias("j", "rank")).join(prefix_df, ["rank", "step"])
    probes = probes.join(sides_df.drop("step"), "template")
    room = 1 + F.least(F.size("tokens") - 1 - F.col("i"), F.col("size") - 1 - F.col("j"))
    probes = probes.where(
        (F.col("size") >= F.col("needed"))  # length
        & (F.col("j") < F.col("size") - F.col("needed") + 1)  # the block's prefix
        & (room >= F.col("needed"))  # position
    ).dropDuplicates(["row", "step", "block", "template"])
    share = F.size(F.array_intersect("known", "tokens"))
    matches = probes.where(share >= F.col("needed"))
    starts = F.filter(
        F.sequence(F.lit(0), F.col("step") - 1),
        lambda s: F.slice("words", s + 1, F.size("sequence")) == F.col("sequence"),
    )
    places = F.when(F.col("phrase"), F.transform(starts, lambda s: s + F.col("block") * F.col("step")))
    return found.select("doc_id", "row", "n_words"), matches.select(
        "row", "step", "block", "label", "phrase", (share / F.size("tokens")).alias("containment"), places.alias("places")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, matches = scan(table(spark, sf_dir, "documents"))
    real = matches.where(~F.col("phrase") | (F.size("places") > 0))
    told = real.groupBy("row").agg(
        F.sum(F.when(F.col("phrase"), F.size("places"))).alias("n_base"),
        F.min(F.array_min("places")).alias("first_word"),
        F.max(F.array_max("places")).alias("last_word"),
        F.collect_set(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"),
        F.collect_set("label").alias("labels"),
        F.max("containment").alias("score"),
    )
    out = docs.join(told, "row", "left")
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        joined("base_labels").alias("base_labels"),
        joined("labels").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle_sql() -> str:
    """The same result by comparing every block with every template."""

    def rows(texts: dict[str, str], phrase: bool) -> list[str]:
        words = [(split(t.encode()), label) for t, label in texts.items()]
        return [f"('{label}', {str(phrase).lower()}, {step_of(len(w))}, string_split('{b' '.join(w).decode()}', ' '))" for w, label in words]

    values = ", ".join(rows(TEMPLATES, False) + rows(PHRASES, True))
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT label, phrase, step, seq, list_distinct(seq) AS tokens FROM (VALUES {values}) AS v(label, phrase, step, seq)),
places AS (SELECT doc_id, label, i - 1 AS i FROM w, t, unnest(range(1, len(w) - len(seq) + 2)) AS u(i)
    WHERE phrase AND w[i:i + len(seq) - 1] = seq),
b AS (SELECT doc_id, step, w[k * step + 1:k * step + 2 * step] AS words
    FROM w, (SELECT DISTINCT step FROM t WHERE NOT phrase) AS s, unnest(range(0, (len(w) + step - 1) // step)) AS u(k)),
m AS (SELECT doc_id, label, len(list_intersect(list_distinct(words), tokens)) / len(tokens) AS share
    FROM b JOIN t ON b.step = t.step WHERE NOT phrase),
found AS (SELECT doc_id, label, share FROM m WHERE share >= {THRESHOLD} - 1e-9 UNION ALL SELECT doc_id, label, 1.0 FROM places),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
    (SELECT string_agg(DISTINCT p.label, ',' ORDER BY p.label) FROM places p WHERE p.doc_id = q.doc_id) AS base_labels
    FROM places q GROUP BY doc_id),
labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
    coalesce(labels, '') AS labels, CAST(coalesce(score, 0.0) AS DOUBLE) AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id)
"""
