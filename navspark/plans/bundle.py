"""The full metric row of every scheme, from one pass over its series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DAYS_PER_YEAR, DEFAULT, MIN_OBS_VOLATILITY, EngineConfig
from ..functions.expr import by_scheme, cagr_pct
from ..operators import benchmark as bm
from ..operators import returns, risk, rolling, sip

#: Decimals of the rounded row; every other metric has two.
DECIMALS = {"history_years": 1, "r_squared": 3, "up_capture_pct": 1, "down_capture_pct": 1}
BENCHMARK_COLUMNS = [
    "overlap_days", "beta", "alpha_pct", "r_squared", "correlation", "tracking_error_pct", "information_ratio",
    "up_capture_pct", "down_capture_pct", "excess_return_1y_pct",
]


def calmar() -> Column:
    return F.try_divide(F.col("cagr_3y_pct"), F.abs("max_drawdown_pct"))


def notes() -> Column:
    short = F.when(
        F.col("history_years") < 3,
        F.concat(F.lit("Only "), F.format_number("history_years", 1), F.lit(" years of history: 3Y and 5Y figures are missing")),
    )
    made_up = F.when(F.col("data_source") == "synthetic", F.lit("SYNTHETIC data: not investable"))
    return F.array_compact(F.array(short, made_up))


def scheme_metrics(nav: DataFrame, benchmark: str | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """All metrics of cleaned series (scheme_code, date, nav, data_source); benchmark columns are NULL without one.

    The series are exchanged once by scheme, unless they come so, and sorted once by day.  Measures of a row and its past come
    from one ordered window; the quantile and the trough, which others need, from a window over the whole scheme behind it;
    everything else from one aggregation.  Without a benchmark nothing is joined.
    """
    if benchmark is not None:
        nav = nav.repartition("scheme_code")  # read by several families
    whole = Window.partitionBy("scheme_code")
    rows = nav.withColumns({
        "i": F.row_number().over(by_scheme()),
        "r": F.col("nav") / F.lag("nav").over(by_scheme()) - 1,
        "prev": F.lag("date").over(by_scheme()),
        "pk": risk.running_peak(),
        "a": rolling.annualised_since(),
    }).withColumns({
        "first": F.min("date").over(whole), "last_date": F.max("date").over(whole), "obs": F.count("*").over(whole),
        "low": F.percentile("r", F.lit(0.05)).over(whole), "known": F.count("r").over(whole), "m": risk.trough_value().over(whole),
    })
    enough = F.col("known") >= MIN_OBS_VOLATILITY
    rows = rows.withColumns({"q": F.when(enough, F.col("low")), "k": sip.trades(last="last_date")})
    found = rows.groupBy("scheme_code").agg(
        F.count("*").alias("observations"), F.min("date").alias("first_date"), F.max("date").alias("end_date"),
        F.max_by("data_source", "date").alias("data_source"), F.min_by("nav", "date").alias("start"),
        F.max_by("nav", "date").alias("end"), F.max("nav").alias("top"),
        *returns.last_averages("i", "obs"),
        *returns.horizon_starts(), *risk.moment_aggs(config), *rolling.stat_aggs(config),
        *risk.drawdown_aggs(), *risk.tail_aggs(), *sip.plan_aggs("k", config),
    )
    found = found.withColumn("x", F.struct(F.col("end").alias("nav"), "sma_50", "sma_200"))
    years = F.datediff("end_date", "first_date") / DAYS_PER_YEAR
    since = F.when(F.col("observations") >= 2, cagr_pct(F.col("start"), F.col("end"), years))
    base = found.select(
        "scheme_code", "observations", "first_date", F.col("end_date").alias("as_of"),
        F.round(years, 6).alias("history_years"), "data_source", *returns.trailing_columns(),
        since.alias("since_inception_cagr_pct"), *risk.moment_columns(config),
        ((F.col("end") / F.col("top") - 1) * 100).alias("current_drawdown_pct"),
        *rolling.stat_columns(F.col("observations")), *returns.signal_columns(),
        *risk.drawdown_columns(), "var_95_pct", "cvar_95_pct", sip.plan_rate("end_date", "end"),
    )
    families = []
    if benchmark is not None:
        aligned = bm.align(nav, benchmark)
        families += [bm.regression(aligned, config), bm.capture_ratios(aligned), bm.excess_1y(aligned)]
    row = reduce(lambda a, b: a.join(b, "scheme_code", "left"), families, base)
    if benchmark is None:
        row = row.withColumns({c: F.lit(None).cast("long" if c == "overlap_days" else "double") for c in BENCHMARK_COLUMNS})
    return row.withColumn("calmar_ratio", calmar()).withColumn("notes", notes())


def rounded(metrics: DataFrame) -> DataFrame:
    """The row for readers: two decimals, half to even, but for DECIMALS."""
    return metrics.select(
        *[
            F.bround(f.name, DECIMALS.get(f.name, 2)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
            for f in metrics.schema.fields
        ]
    )
