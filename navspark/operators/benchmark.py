"""Measures against a benchmark series; returns are taken after both series are aligned on common days."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, MIN_CAPTURE_MONTHS, MIN_OBS_REGRESSION, TRADING_DAYS, EngineConfig
from ..functions.expr import by_scheme, finite
from .returns import horizon_starts, trailing, with_last_date


def align(nav: DataFrame, benchmark: str) -> DataFrame:
    """scheme_code, date, nav, bnav on days that both have; the benchmark is not measured against itself."""
    bench = nav.where(F.col("scheme_code") == benchmark).select("date", F.col("nav").alias("bnav"))
    # one series, so its size is bounded by the days of the calendar
    return nav.where(F.col("scheme_code") != benchmark).select("scheme_code", "date", "nav").join(F.broadcast(bench), "date")


def regression(aligned: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """overlap_days, beta, alpha_pct, r_squared, correlation, tracking_error_pct, information_ratio."""
    rd, w = config.daily_risk_free, by_scheme()
    f = F.col("nav") / F.lag("nav").over(w) - 1
    b = F.col("bnav") / F.lag("bnav").over(w) - 1
    both = aligned.select("scheme_code", f.alias("f"), b.alias("b")).where(F.col("f").isNotNull())
    found = both.groupBy("scheme_code").agg(
        F.count("f").alias("n"), F.covar_samp("f", "b").alias("cov"), F.var_samp("b").alias("var"),
        F.avg("f").alias("mf"), F.avg("b").alias("mb"), F.stddev_samp("f").alias("sf"),
        F.stddev_samp(F.col("f") - F.col("b")).alias("te"), F.avg(F.col("f") - F.col("b")).alias("active"),
    )
    ok = (F.col("n") >= MIN_OBS_REGRESSION) & (F.col("var") > 0)
    # corr() fails on a flat series, where the correlation is unknown
    found = found.withColumns({
        "beta": F.when(ok, F.try_divide(F.col("cov"), F.col("var"))),
        "corr": F.try_divide(F.col("cov"), F.col("sf") * F.sqrt("var")),
    })
    daily = (F.col("mf") - rd) - F.col("beta") * (F.col("mb") - rd)
    te = F.when(F.col("beta").isNotNull(), F.col("te") * math.sqrt(TRADING_DAYS) * 100)
    return found.select(
        "scheme_code",
        F.col("n").alias("overlap_days"),
        "beta",
        ((F.pow(1 + daily, TRADING_DAYS) - 1) * 100).alias("alpha_pct"),
        F.when(F.col("beta").isNotNull(), finite(F.col("corr") * F.col("corr"))).alias("r_squared"),
        F.when(F.col("beta").isNotNull(), finite(F.col("corr"))).alias("correlation"),
        te.alias("tracking_error_pct"),
        F.try_divide(F.col("active") * TRADING_DAYS * 100, te).alias("information_ratio"),
    )


def capture_ratios(aligned: DataFrame) -> DataFrame:
    """up_capture_pct and down_capture_pct: compound fund over compound benchmark return in up and in down months."""
    monthly = aligned.groupBy("scheme_code", F.trunc("date", "MM").alias("month")).agg(
        F.max_by("nav", "date").alias("nav"), F.max_by("bnav", "date").alias("bnav")
    )
    w = Window.partitionBy("scheme_code").orderBy("month")
    both = monthly.select(
        "scheme_code",
        (F.col("nav") / F.lag("nav").over(w) - 1).alias("f"),
        (F.col("bnav") / F.lag("bnav").over(w) - 1).alias("b"),
    ).where(F.col("f").isNotNull())
    aggs, out = [], []
    for side, rows in (("up", F.col("b") > 0), ("down", F.col("b") < 0)):
        aggs += [F.count_if(rows).alias(f"{side}_n")]
        aggs += [F.product(F.when(rows, 1 + F.col(x))).alias(f"{side}_{x}") for x in "fb"]
        ratio = F.try_divide(F.col(f"{side}_f") - 1, F.col(f"{side}_b") - 1) * 100
        out.append(F.when(F.col(f"{side}_n") >= MIN_CAPTURE_MONTHS, ratio).alias(f"{side}_capture_pct"))
    return both.groupBy("scheme_code").agg(*aggs).select("scheme_code", *out)


def excess_1y(aligned: DataFrame) -> DataFrame:
    """excess_return_1y_pct: the fund's less the benchmark's trailing year on the aligned days."""
    found = with_last_date(aligned).groupBy("scheme_code").agg(
        F.max("last_date").alias("end_date"), F.max_by("nav", "date").alias("end"), F.max_by("bnav", "date").alias("bend"),
        *horizon_starts("nav")[4:6], horizon_starts("bnav")[4],
    )
    one = lambda start, end: trailing("1y", F.col(start), F.col("date_1y"), F.col(end), F.col("end_date"))
    return found.select("scheme_code", (one("nav_1y", "end") - one("bnav_1y", "bend")).alias("excess_return_1y_pct"))
