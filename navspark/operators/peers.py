"""Ranks, percentiles and composite scores inside a category; all categories in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MIN_PEERS, PEER_CAP

#: Metrics that are ranked, those where less is better, the score's components and weights (fixed values).
RANKED_METRICS = [
    "return_1y_pct",
    "cagr_3y_pct",
    "cagr_5y_pct",
    "sharpe_ratio",
    "sortino_ratio",
    "calmar_ratio",
    "volatility_pct",
    "max_drawdown_pct",
    "sip_xirr_3y_pct",
]
LOWER_IS_BETTER = ["volatility_pct", "downside_deviation_pct", "var_95_pct", "cvar_95_pct", "tracking_error_pct"]
COMPONENTS = {
    "returns": ["return_1y_pct", "cagr_3y_pct", "cagr_5y_pct"],
    "risk_adjusted": ["sharpe_ratio", "sortino_ratio", "calmar_ratio"],
    "drawdown": ["max_drawdown_pct", "volatility_pct"],
    "consistency": ["sip_xirr_3y_pct"],
}
#: Stripes an octave, roughly, into which a group's values are dealt.
STRIPES = 500
WEIGHTS = {"returns": 0.35, "risk_adjusted": 0.35, "drawdown": 0.20, "consistency": 0.10}


def peer_universe(metrics: DataFrame, counts: DataFrame, min_observations: int = 30, cap: int = PEER_CAP) -> DataFrame:
    """The deepest ``cap`` schemes of each category with enough raw rows; ties go by code."""
    w = Window.partitionBy("scheme_category").orderBy(F.col("raw_rows").desc(), "scheme_code")
    rows = metrics.join(counts.where(F.col("raw_rows") >= min_observations), "scheme_code")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n", "raw_rows")


def value_ranks(values: DataFrame, *group: str) -> DataFrame:
    """values: group columns and a finite ``x``.  Of each distinct value of a group: ``below`` and ``upto``, the rows with less and
    with no more, and of its group ``n``, the rows, and ``middle``, the median.

    A group may hold any share of the rows.  Its distinct values are counted first, then dealt by stripes, a monotone function of
    the value; a running count orders the values of a stripe, and a running count over a group's stripes adds what lies below.
    So no task holds a group: a stripe is 1 / STRIPES of a value wide, and the stripes of a group are a table of its stripes.
    """
    stripe = F.floor(F.signum("x") * F.log1p(F.abs("x") * 1000) * STRIPES).alias("stripe")
    counted = values.groupBy(*group, "x").agg(F.count("*").alias("c")).withColumn("stripe", stripe)
    inside = Window.partitionBy(*group, "stripe").orderBy("x")
    running = counted.withColumn("upto", F.sum("c").over(inside))
    stripes = counted.groupBy(*group, "stripe").agg(F.sum("c").alias("s"))
    whole = Window.partitionBy(*group)
    placed = stripes.select(
        *group, "stripe", (F.sum("s").over(whole.orderBy("stripe")) - F.col("s")).alias("before"), F.sum("s").over(whole).alias("n")
    )
    ranks = running.join(placed, [*group, "stripe"]).select(
        *group, "x", "n", (F.col("before") + F.col("upto") - F.col("c")).alias("below"), (F.col("before") + F.col("upto")).alias("upto")
    )
    half = F.col("n") - 1
    at = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("upto")), F.col("x")))
    middle = ranks.groupBy(*group).agg(((at(F.floor(half / 2)) + at(F.ceil(half / 2))) / 2).alias("middle"))
    return ranks.join(middle, list(group))


def peer_ranks(metrics: DataFrame, ranked: list[str] = RANKED_METRICS) -> DataFrame:
    """Long: scheme_code, scheme_category, metric, value, percentile, rank, peers, category_median, higher_is_better,
    quartile.  Mid-rank percentiles, the scheme itself included; metrics with under MIN_PEERS values are left out.
    Schemes without a category are a category of their own."""
    known = F.coalesce(F.concat(F.lit("="), "scheme_category"), F.lit(""))
    long = metrics.unpivot(["scheme_code", "scheme_category"], ranked, "metric", "value").where("value is not null and not isnan(value)")
    better = ~F.col("metric").isin(LOWER_IS_BETTER)
    long = long.select("*", known.alias("_k"), F.when(better, F.col("value")).otherwise(-F.col("value")).alias("x"))
    found = long.join(value_ranks(long.select("_k", "metric", "x"), "_k", "metric"), ["_k", "metric", "x"])
    percentile = (F.col("below") + F.col("upto")) / 2.0 / F.col("n") * 100
    return found.where(F.col("n") >= MIN_PEERS).select(
        "scheme_code", "scheme_category", "metric", "value", F.col("n").alias("peers"), percentile.alias("percentile"),
        (F.col("n") - F.col("upto") + 1).alias("rank"),
        F.when(better, F.col("middle")).otherwise(-F.col("middle")).alias("category_median"), better.alias("higher_is_better"),
        F.least(F.lit(4), F.floor((100 - percentile) / 25).cast("int") + 1).alias("quartile"),
    )


def comparisons(ranks: DataFrame) -> DataFrame:
    """A row a scheme: peers, pct_<metric>, and the metrics in the top and in the bottom quartile."""
    top = lambda q: F.array_sort(F.collect_list(F.when(F.col("quartile") == q, F.col("metric"))))
    base = ranks.groupBy("scheme_code").agg(F.max("peers").alias("peers"), top(1).alias("top_quartile"), top(4).alias("bottom_quartile"))
    wide = ranks.groupBy("scheme_code").pivot("metric", RANKED_METRICS).agg(F.round(F.first("percentile"), 1))
    return base.join(wide.withColumnsRenamed({m: f"pct_{m}" for m in RANKED_METRICS}), "scheme_code")


def category_summary(metrics: DataFrame) -> DataFrame:
    """scheme_category, metric, median, best (the least where less is better), to two decimals."""
    long = metrics.unpivot(["scheme_category"], RANKED_METRICS, "metric", "value")
    best = F.when(F.col("metric").isin(LOWER_IS_BETTER), F.min("value")).otherwise(F.max("value"))
    return long.groupBy("scheme_category", "metric").agg(
        F.bround(F.round(F.median("value"), 6), 2).alias("median"), F.bround(best, 2).alias("best"), F.count("value").alias("schemes")
    )


def _mean(columns: list[Column]) -> Column:
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in columns[1:]), F.when(columns[0].isNotNull(), 1).otherwise(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0.0)))
    return F.when(n > 0, total / n)


def composite_scores(metrics: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The metric rows with score_<component>, score (one decimal) and score_components.

    A component is the mean of the percentiles it has; the score weighs the components it has.
    """
    ranks = peer_ranks(metrics).groupBy("scheme_code").pivot("metric", RANKED_METRICS).agg(F.first("percentile"))
    ranks = ranks.withColumnsRenamed({m: f"pct_{m}" for m in RANKED_METRICS})
    enough = F.count("*").over(Window.partitionBy("scheme_category")) >= MIN_PEERS
    rows = metrics.withColumn("_enough", enough).join(ranks, "scheme_code", "left")
    parts = {c: F.when(F.col("_enough"), _mean([F.col(f"pct_{m}") for m in ms])) for c, ms in COMPONENTS.items()}
    rows = rows.withColumns({f"score_{c}": e for c, e in parts.items()})
    has = {c: F.col(f"score_{c}").isNotNull() for c in COMPONENTS}
    weight = sum((F.when(h, F.lit(weights.get(c, 0.0))).otherwise(0.0) for c, h in has.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(f"score_{c}") * weights.get(c, 0.0), F.lit(0.0)) for c in COMPONENTS), F.lit(0.0))
    return rows.withColumns({
        "score": F.when(weight > 0, F.bround(F.round(total / weight, 9), 1)),
        "score_components": sum((F.when(h, 1).otherwise(0) for h in has.values()), F.lit(0)),
    }).drop("_enough")


def explain_scores(scored: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """scheme_code, score, peers, component, value, weight (renormalised) and contribution; value is NULL if missing."""
    peers = F.count("*").over(Window.partitionBy("scheme_category"))
    has = sum((F.when(F.col(f"score_{c}").isNotNull(), F.lit(weights.get(c, 0.0))).otherwise(0.0) for c in COMPONENTS), F.lit(0.0))
    parts = F.array(*[
        F.struct(F.lit(c).alias("component"), F.col(f"score_{c}").alias("value"), F.lit(weights.get(c, 0.0)).alias("w"))
        for c in COMPONENTS
    ])
    rows = scored.select("scheme_code", "score", peers.cast("long").alias("peers"), has.alias("_has"), parts.alias("p"))
    rows = rows.withColumn("p", F.explode("p"))
    weight = F.when(F.col("p.value").isNotNull(), F.try_divide(F.col("p.w"), F.col("_has")))
    return rows.select(
        "scheme_code", "score", "peers", F.col("p.component").alias("component"), F.col("p.value").alias("value"),
        weight.alias("weight"), (weight * F.col("p.value")).alias("contribution"),
    )
