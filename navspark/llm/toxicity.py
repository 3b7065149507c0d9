"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is a logistic function of its words; a document is toxic if
some sentence is, so its score is the noisy-or 1 - prod(1 - score).  Only documents are labelled: the gradient of the
document's likelihood reaches the sentences through the noisy-or, and the trained sentence scores then locate the
offending ones.

A word counts by itself and by its first four and first five characters, so that inflected forms share weight.

Training takes at most ``SAMPLE`` labelled documents of each class, those with the smallest hash of the id, one row
each (that with the smallest hash of the text): the documented bound of what is collected.  The likelihood weighs the
classes by how often they are labelled in all, so that the cut at 0.5 means the same at every size of the table.
Everything else runs over all documents in tasks.

Defined cases: null and empty texts have no sentence and score 0; documents labelled both ways count as toxic; without
both labels in the sample every score is 0; repeated rows are scored each; input columns other than the text are never
read by the model and come back in the struct ``row``, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BYTES, fold, released, table, text_bytes

SAMPLE, STEPS, RATE, RIDGE, START = 5000, 400, 0.15, 1e-2, -8.0
#: Features are in so many documents of the sample at least (whichever is more), and this much likelier in one class.
LEAST_DOCS, LEAST_SHARE, ODDS = 3, 0.002, 3.0
CACHED_WORDS = 300_000
#: As WORD_BYTES, but the ends of sentences become a mark that no word holds.
MARK = b"\x00"
SENTENCE_BYTES = bytes(0 if c in b".!?\n" else b for c, b in enumerate(WORD_BYTES))


def sentences(text: bytes) -> list[list[bytes]]:
    """Words of each sentence that has one."""
    return [w for w in (s.split() for s in text.translate(SENTENCE_BYTES).split(MARK)) if w]


def features(word: bytes) -> list[str]:
    w = word.decode(errors="replace")
    return [w, "4" + w[:4], "5" + w[:5]] if len(w) > 5 else [w, "4" + w[:4]] if len(w) > 4 else [w]


def train(
    bags: list[list[np.ndarray]], vocabulary: list[bytes], toxic: np.ndarray, share: float
) -> tuple[dict[str, float], float]:
    """Weights of features and the bias, from documents' sentences as numbers of vocabulary words; share: that of toxic
    documents among all labelled ones.

    Features that are rare or about as likely in both classes have no weight.
    """
    docs_with: tuple[dict[str, int], dict[str, int]] = ({}, {})
    known = [features(w) for w in vocabulary]
    for bag, y in zip(bags, toxic.tolist()):
        tally = docs_with[y]
        for f in {f for w in {w for s in bag for w in s.tolist()} for f in known[w]}:
            tally[f] = tally.get(f, 0) + 1
    least, (clean, bad) = max(LEAST_DOCS, LEAST_SHARE * len(bags)), docs_with
    n_bad = int(toxic.sum())
    ratio = (len(bags) - n_bad + 1) / (n_bad + 1)
    chosen = []
    for f in sorted(clean.keys() | bad.keys()):
        c, t = clean.get(f, 0), bad.get(f, 0)
        odds = ratio * (t + 0.5) / (c + 0.5)
        if c + t >= least and (odds >= ODDS or odds <= 1 / ODDS):
            chosen.append(f)
    index = {f: i for i, f in enumerate(chosen)}
    codes = [[index[f] for f in fs if f in index] for fs in known]
    flat, lengths, sizes = [], [], []
    for bag in bags:
        sizes.append(len(bag))
        for s in bag:
            f = {i for w in s.tolist() for i in codes[w]}
            flat.append(np.fromiter(f, np.int32, len(f)))
            lengths.append(len(f))
    at = np.concatenate(flat) if flat else np.zeros(0, np.int32)
    sentence = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    doc = np.repeat(np.arange(len(bags)), sizes)
    weight = np.where(toxic, share / n_bad, (1 - share) / (len(bags) - n_bad))
    w, b = np.zeros(len(index)), START
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, STEPS + 1):
        z = np.bincount(sentence, w[at], minlength=len(lengths)) + b
        soft = np.logaddexp(0, z)  # -log(1 - score)
        left = np.bincount(doc, soft, minlength=len(bags))
        pull = np.where(toxic, -1 / np.expm1(np.clip(left, 1e-9, 50)), 1.0) * weight
        dz = pull[doc] * np.exp(z - soft)
        g, gb = np.bincount(at, dz[sentence], minlength=len(w)) + RIDGE * w / len(bags), dz.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix, fix2 = 1 - 0.9**t, 1 - 0.999**t
        w -= RATE * (m / fix) / (np.sqrt(v / fix2) + 1e-8)
        b -= RATE * (mb / fix) / (np.sqrt(vb / fix2) + 1e-8)
    return {f: float(w[i]) for f, i in index.items()}, float(b)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], float] | None:
    marks = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg((F.max("toxic") > 0).alias("toxic"))
    counted = dict(marks.groupBy("toxic").count().collect())  # two rows
    drawn = [marks.where(F.col("toxic") == toxic).orderBy(F.xxhash64("id"), "id").limit(sample) for toxic in (True, False)]
    # at most twice the sample, so its side of the join is bounded
    both = F.broadcast(drawn[0].unionByName(drawn[1]))
    rows = docs.select("doc_id", text_bytes().alias("text")).join(both, F.col("doc_id") == F.col("id"))
    rows = rows.groupBy("id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    numbers: dict[bytes, int] = {}
    bags, toxic = [], []
    for text, y in rows.orderBy("id").select("text", "toxic").toLocalIterator():
        bag = sentences(bytes(text))
        bags.append([np.array([numbers.setdefault(w, len(numbers)) for w in s], np.int32) for s in bag])
        toxic.append(y)
    if all(toxic) or not any(toxic):
        return None
    return train(bags, list(numbers), np.array(toxic), counted[True] / (counted[True] + counted[False]))


class Scorer:
    """Sentence scores of texts; word weights are kept for up to CACHED_WORDS words."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.words = weights, bias, {}

    def weigh(self, words: set[bytes]) -> None:
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        get = self.weights.get
        for w in words.difference(self.words):
            self.words[w] = tuple((f, x) for f in features(w) if (x := get(f)))

    def __call__(self, text: bytes) -> np.ndarray:
        """The sentences' log odds."""
        bag = sentences(text)
        self.weigh({w for s in bag for w in s})
        of = self.words
        return np.array([sum(dict(p for w in s for p in of[w]).values()) for s in bag]) + self.bias


def score(docs: DataFrame, model: tuple[dict[str, float], float] | None) -> DataFrame:
    """row (a struct of the input columns but the text), score, and the numbers and scores of offending sentences (from
    0.5)."""
    kind = pa.list_(pa.struct([("sentence", pa.int64()), ("score", pa.float64())]))
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's words
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), text_bytes().alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*held.value) if held.value else None
        for batch in batches:
            scores, offending = [], []
            for text in batch.column("text"):
                z = scorer(text.as_py()) if scorer else np.zeros(0)
                # the noisy-or: log(1 - sentence's score) is -log(1 + e^z)
                scores.append(float(-np.expm1(-np.logaddexp(0, z).sum())))
                offending.append([{"sentence": i, "score": float(1 / (1 + np.exp(-z[i])))} for i in np.flatnonzero(z >= 0).tolist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(scores, pa.float64()), pa.array(offending, kind)], ["row", "score", "offending"]
            )

    offences = T.ArrayType(T.StructType([T.StructField("sentence", T.LongType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("offending", offences)])
    return rows.mapInArrow(released(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    found = score(docs, fit(docs, learn))
    return found.select(
        "row.doc_id",
        (fold("row.doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )
