"""Distribution of overlapping annualised returns over a rolling window of years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DAYS_PER_YEAR, DEFAULT, MIN_OBS_VOLATILITY, MIN_ROLLING_WINDOWS, EngineConfig
from ..functions.expr import by_scheme, share_pct


def annualised_since(years: float = 3.0) -> Column:
    """Per row: the annualised return since the last NAV at least a window earlier, NULL without one.

    The start is the last row of a range frame that ends a window before the day; no as-of join is needed.
    """
    days = round(years * DAYS_PER_YEAR)
    start = F.last(F.struct("nav", "date")).over(by_scheme().rangeBetween(Window.unboundedPreceding, -days))
    elapsed = F.datediff("date", start["date"])
    grown = (F.pow(F.col("nav") / start["nav"], DAYS_PER_YEAR / elapsed) - 1) * 100
    return F.when(elapsed >= 0.9 * days, grown)


def stat_aggs(config: EngineConfig = DEFAULT) -> list[Column]:
    """Aggregates of a column a of annualised_since()."""
    return [
        F.count("a").alias("rolling_3y_observations"),
        F.min("a").alias("rolling_3y_min_pct"),
        F.median("a").alias("rolling_3y_median_pct"),
        F.max("a").alias("rolling_3y_max_pct"),
        share_pct(F.col("a") > 0).alias("rolling_3y_positive_share_pct"),
        share_pct(F.col("a") > config.risk_free * 100).alias("rolling_3y_beat_hurdle_pct"),
    ]


def stat_columns(rows: Column) -> list[Column]:
    """The statistics where there are enough windows and rows."""
    enough = (F.col("rolling_3y_observations") >= MIN_ROLLING_WINDOWS) & (rows >= MIN_OBS_VOLATILITY)
    names = ["observations", "min_pct", "median_pct", "max_pct", "positive_share_pct", "beat_hurdle_pct"]
    return [F.when(enough, F.col(f"rolling_3y_{n}")).alias(f"rolling_3y_{n}") for n in names]


def rolling_stats(nav: DataFrame, years: float = 3.0, config: EngineConfig = DEFAULT) -> DataFrame:
    rows = nav.select("scheme_code", annualised_since(years).alias("a"))
    stats = rows.groupBy("scheme_code").agg(F.count("*").alias("n"), *stat_aggs(config))
    return stats.select("scheme_code", *stat_columns(F.col("n"))).where("rolling_3y_observations is not null")
