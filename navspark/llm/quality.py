"""Quality rules with risk-controlled thresholds.

Each rule compares one rate of a document with a cutoff; rates are dealt into BINS bins of a fixed width a rule.  The cutoffs
are learned per stratum (language) from labelled documents so that the rules together reject few good ones.  A stratum's
candidates are whole rule sets, all rules cut at the same bin, and are tested from the most lenient on: a set is valid while
the exact binomial tail P(Bin(good, risk) <= rejected good) stays under the level, and testing stops at the first that is not
(fixed-sequence testing needs no further correction).  The level is ``delta / strata``, Bonferroni's correction over the
strata.  So with probability 1 - delta no stratum loses more than the share ``risk`` of its good documents.  A valid set is
used only if it also rejects some labelled bad document.

The same test serves every size: one that has fewer than ln(level) / ln(1 - risk) good labels (217 with four strata) cannot
be passed, and then the rules keep everything.  The bound takes labelled documents as independent draws.  A document is one
draw however many rows it has, by its worst row; copies of a text under different ids are draws each, so labels should be drawn
from a deduplicated corpus.

Strata with less than 1 / MAX_STRATA of the labelled documents are pooled in one, so at most MAX_STRATA + 1 rows are
collected and broadcast, whatever the tables hold.

Defined cases: a null text has no words and fails the base rule; a null language is the stratum ''; a document labelled
both good and bad counts as good; null labels are no labels; repeated rows are judged each; without labels nothing
but the base rule rejects.  Input columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, forget, mix64, released, sliced, stored, table, text_bytes

RISK, DELTA, MAX_STRATA, BINS = 0.02, 0.05, 4096, 64
REPEAT_WORDS = 8
SYMBOLS, UPPER = b"#*$%&|<>", bytes(range(65, 91))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
#: Rate of each rule, as (numerator, denominator); a document is rejected above the cutoff.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "long_words": ("word_chars", "n_words"),
}
#: Rates at or above which a rule's last bin begins; bins divide zero to this evenly.
TOPS = {"symbols": 0.5, "dup_lines": 1.0, "repeats": 1.0, "upper": 1.0, "long_words": 32.0}


def repeated_words(words: list[list[bytes]], size: int = REPEAT_WORDS) -> np.ndarray:
    """Per text, the words inside windows of ``size`` words that stand in it twice or more."""
    sizes = np.array([len(w) for w in words], np.int64)
    total, starts = int(sizes.sum()), np.cumsum(sizes) - sizes
    out = np.zeros(len(words), np.int64)
    if total < size:
        return out
    h = np.fromiter((x for w in words for x in map(hash, w)), np.int64, total).view(np.uint64)
    h, text = mix64(h), np.repeat(np.arange(len(words)), sizes)
    key = mix64(text[: total - size + 1].astype(np.uint64) + np.uint64(1))
    for j in range(size):
        key = (key ^ h[j : total - size + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    inside = np.flatnonzero(text[: total - size + 1] == text[size - 1 :])
    order = inside[np.argsort(key[inside], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    twice = np.r_[same, False] | np.r_[False, same]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, order[twice], 1)
    np.add.at(edge, order[twice] + size, -1)
    covered = np.r_[0, np.cumsum(np.cumsum(edge[:-1]) > 0)]
    return covered[starts + sizes] - covered[starts]


def counts(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """row, a struct of the kept columns (all by default), and COUNTS of each text."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                texts = batch.column("text").to_pylist()
                words = [t.split() for t in texts]
                rows = []
                for t, w in zip(texts, words):
                    joined = b"".join(w)
                    lines = [x for x in t.split(b"\n") if x.strip()]
                    rows.append((
                        len(w), len(joined.decode()), len(t) - len(t.translate(None, SYMBOLS)),
                        len(lines) - len(set(lines)), 0, len(lines), len(joined) - len(joined.translate(None, UPPER)),
                    ))
                table_ = np.array(rows, np.int64).reshape(-1, len(COUNTS))
                table_[:, 4] = repeated_words(words)
                yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, table_.T)], ["row", *COUNTS])

    rows = carried(docs) if keep is None else docs.select(F.struct(*keep).alias("row"), text_bytes().alias("text"))
    schema = T.StructType([rows.schema["row"], *[T.StructField(c, T.LongType()) for c in COUNTS]])
    return rows.mapInArrow(released(count), schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def stratum() -> Column:
    return F.coalesce("row.lang", F.lit(""))


def rate(rule: str) -> Column:
    part, whole = RULES[rule]
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def rate_bin(rule: str) -> Column:
    return F.least(F.floor(rate(rule) * BINS / TOPS[rule]).cast("int"), F.lit(BINS))


def log_tail(k: int, n: int, p: float) -> float:
    """log P(Bin(n, p) <= k)."""
    i = np.arange(k + 1)
    ways = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i.tolist()])
    terms = ways + i * math.log(p) + (n - i) * math.log1p(-p)
    top = terms.max()
    return float(min(0.0, top + math.log(np.exp(terms - top).sum())))


def cutoff(good: np.ndarray, bad: np.ndarray, risk: float, level: float) -> int | None:
    """The smallest bin from which documents may be rejected, of BINS + 1 bins' labelled documents."""
    n, best = int(good.sum()), None
    lost, caught = good[::-1].cumsum()[::-1], bad[::-1].cumsum()[::-1]
    for b in range(len(good) - 1, 0, -1):
        if n == 0 or (lost[b] >= n * risk) or log_tail(int(lost[b]), n, risk) > math.log(level):
            break
        if caught[b] > (caught[best] if best is not None else 0):
            best = b
    return best


def fit(counted: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> tuple[list[str], list[tuple]]:
    """Strata of their own, and (stratum, cutoff bin of all rules or None); None is the pooled stratum."""
    marks = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("good"))
    seen = counted.where(~base_failed()).join(marks, F.col("row.doc_id") == F.col("id"))
    seen = seen.groupBy("id", stratum().alias("stratum")).agg(
        (F.max("good") > 0).cast("int").alias("good"), F.max(F.greatest(*[rate_bin(r) for r in RULES])).alias("bin")
    )
    seen = stored(seen, "quality-labelled")
    total = seen.count()
    own = [
        r[0]
        for r in seen.groupBy("stratum").count().where(F.col("count") * MAX_STRATA >= max(1, total)).collect()
    ]
    pooled = F.when(F.col("stratum").isin(own), F.col("stratum"))
    table_: dict[str | None, np.ndarray] = {}
    for s, b, good, n in seen.groupBy(pooled.alias("s"), "bin", "good").count().collect():
        table_.setdefault(s, np.zeros((2, BINS + 1), np.int64))[good, b] = n
    forget(seen)
    level = delta / max(1, len(table_))
    return own, [(s, cutoff(t[1], t[0], risk, level)) for s, t in table_.items()]


def judge(counted: DataFrame, own: list[str], rows: list[tuple]) -> DataFrame:
    """Adds base_failed and kept to row and COUNTS."""
    cuts = [("" if s is None else f"={s}", cut) for s, cut in rows]
    # Arrow tables are rows of the plan; lists of Python rows would start Python workers of their own on every executor
    names, bins = [s for s, _ in cuts], [cut for _, cut in cuts]
    rules = pa.table({"cuts_of": pa.array(names, pa.string()), "cut": pa.array(bins, pa.int32())})
    rules, known = (F.broadcast(counted.sparkSession.createDataFrame(t)) for t in (rules, pa.table({"own": pa.array(own, pa.string())})))
    marked = counted.join(known, stratum() == F.col("own"), "left")
    key = F.when(F.col("own").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "own"))
    marked = marked.join(rules, key == F.col("cuts_of"), "left")
    rejected = F.coalesce(F.greatest(*[rate_bin(r) for r in RULES]) >= F.col("cut"), F.lit(False))
    failed = base_failed()
    return marked.select("row", *COUNTS, failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their columns."""
    counted = stored(counts(docs), "quality-counts")
    own, rows = fit(counted, labels)
    return judge(counted, own, rows).where("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stored(counts(table(spark, sf_dir, "documents"), ["doc_id", "lang"]), "quality-counts")
    own, rows = fit(counted, table(spark, sf_dir, "labels"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(counted, own, rows).select("row.doc_id", *names)
