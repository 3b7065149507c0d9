"""Volatility, downside, Sharpe, Sortino, tails and drawdowns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, MIN_OBS_VOLATILITY, TRADING_DAYS, EngineConfig
from ..functions.expr import by_scheme, finite, share_pct
from .returns import daily_returns

YEAR = math.sqrt(TRADING_DAYS)


def moment_aggs(config: EngineConfig = DEFAULT) -> list[Column]:
    """Aggregates of a column r of daily returns (NULL on a scheme's first day)."""
    short = F.least(F.col("r") - config.daily_risk_free, F.lit(0.0))
    down = F.when(F.col("r").isNotNull(), short * short)
    return [
        F.count("r").alias("n_r"), F.stddev_samp("r").alias("sd"), F.avg("r").alias("mean"),
        F.sqrt(F.avg(down)).alias("down"), share_pct(F.col("r") >= 0).alias("positive_days_pct"),
    ]


def moment_columns(config: EngineConfig = DEFAULT) -> list[Column]:
    enough = F.col("n_r") >= MIN_OBS_VOLATILITY
    over = F.col("mean") - config.daily_risk_free
    down = F.col("down") * YEAR * 100
    return [
        F.when(enough, F.col("sd") * YEAR * 100).alias("volatility_pct"),
        F.when(enough, down).alias("downside_deviation_pct"),
        F.when(enough, finite(F.try_divide(over, F.col("sd")) * YEAR)).alias("sharpe_ratio"),
        F.when(enough, finite(F.try_divide(over * TRADING_DAYS * 100, down))).alias("sortino_ratio"),
        F.col("positive_days_pct"),
    ]


def return_moments(nav: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """volatility_pct, downside_deviation_pct, sharpe_ratio, sortino_ratio and positive_days_pct in one aggregation."""
    found = daily_returns(nav).groupBy("scheme_code").agg(*moment_aggs(config))
    return found.select("scheme_code", *moment_columns(config))


def tail_aggs() -> list[Column]:
    """Aggregates of a column r, given the quantile q of its scheme."""
    return [
        (F.abs(F.max("q")) * 100).alias("var_95_pct"),
        (F.abs(F.avg(F.when(F.col("r") <= F.col("q"), F.col("r")))) * 100).alias("cvar_95_pct"),
    ]


def tail_risk(nav: DataFrame, tail: float = 0.05) -> DataFrame:
    """var_95_pct and cvar_95_pct: the interpolated quantile of daily returns, and the mean at or under it."""
    r = daily_returns(nav)
    cut = r.groupBy("scheme_code").agg(F.percentile("r", F.lit(tail)).alias("q"), F.count("r").alias("n"))
    cut = cut.where(F.col("n") >= MIN_OBS_VOLATILITY)
    return r.join(cut, "scheme_code").groupBy("scheme_code").agg(*tail_aggs())


def drawdown_series(nav: DataFrame) -> DataFrame:
    peak = F.max("nav").over(by_scheme().rowsBetween(Window.unboundedPreceding, 0))
    return nav.select("scheme_code", "date", "nav", peak.alias("peak"), ((F.col("nav") / peak - 1) * 100).alias("drawdown_pct"))


def running_peak() -> Column:
    return F.max("nav").over(by_scheme().rowsBetween(Window.unboundedPreceding, 0))


def trough_value() -> Column:
    """The first row furthest under its running peak pk, as (dd, date, pk)."""
    return F.min(F.struct((F.col("nav") / F.col("pk") - 1).alias("dd"), "date", "pk"))


def trough_agg() -> Column:
    return trough_value().alias("m")


def drawdown_aggs() -> list[Column]:
    """Peak and recovery days around the trough m of the scheme."""
    peak = (F.col("nav") == F.col("m.pk")) & (F.col("date") <= F.col("m.date"))
    back = (F.col("nav") >= F.col("m.pk")) & (F.col("date") >= F.col("m.date"))
    return [
        F.first("m").alias("m"), F.max("date").alias("last"), F.count("*").alias("n"),
        F.min(F.when(peak, F.col("date"))).alias("peak"), F.min(F.when(back, F.col("date"))).alias("back"),
    ]


def drawdown_columns() -> list[Column]:
    fell, enough = F.col("m.dd") < 0, F.col("n") >= 2
    days = F.when(fell, F.datediff(F.coalesce("back", "last"), F.col("peak"))).otherwise(0)
    return [
        F.when(enough, F.col("m.dd") * 100).alias("max_drawdown_pct"),
        F.when(enough & fell, F.col("peak")).alias("max_drawdown_peak"),
        F.when(enough & fell, F.col("m.date")).alias("max_drawdown_trough"),
        F.when(enough & fell, F.col("back")).alias("max_drawdown_recovery"),
        F.when(enough, days).alias("max_drawdown_days"),
        F.when(enough, ~fell | F.col("back").isNotNull()).alias("max_drawdown_recovered"),
    ]


def max_drawdown(nav: DataFrame) -> DataFrame:
    """Depth, peak, trough and recovery days, length and whether recovered; the first trough and first peak win ties."""
    rows = nav.select("scheme_code", "date", "nav", running_peak().alias("pk"))
    low = rows.groupBy("scheme_code").agg(trough_agg())
    found = rows.join(low, "scheme_code").groupBy("scheme_code").agg(*drawdown_aggs())
    return found.select("scheme_code", *drawdown_columns()).where("max_drawdown_pct is not null")


def current_drawdown(nav: DataFrame) -> DataFrame:
    found = nav.groupBy("scheme_code").agg(F.max_by("nav", "date").alias("latest"), F.max("nav").alias("top"))
    return found.select("scheme_code", ((F.col("latest") / F.col("top") - 1) * 100).alias("current_drawdown_pct"))


def means(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the mean of each column's known, finite values; NULL without any."""
    known = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    return metrics.agg(*[F.avg(known(c)).alias(c) for c in columns])
