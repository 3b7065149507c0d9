"""Quality gate over the raw panel: eleven checks per scheme, from one aggregation."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DAYS_PER_YEAR, DEFAULT, EngineConfig
from ..functions.expr import business_gap

SEVERITIES = ["CRITICAL", "WARNING", "INFO"]


def ingredients(raw: DataFrame, today: datetime.date, config: EngineConfig = DEFAULT) -> DataFrame:
    """What the checks need, a row a scheme; raw may hold NULLs, NaN, repeats and bad values."""
    raw = raw.withColumn("nav", F.when(~F.isnan("nav"), F.col("nav")))
    w = Window.partitionBy("scheme_code").orderBy(F.unix_date("date"), "nav")
    prev, day = F.lag("nav").over(w), F.lag("date").over(w)
    # a move from zero is infinite, so extreme
    move = F.when(prev == 0, F.when(F.col("nav") != 0, float("inf"))).otherwise(F.abs(F.col("nav") / prev - 1) * 100)
    # a day's rows are neighbours: each but the first repeats the one before it
    rows = raw.withColumns({"_move": move, "_gap": business_gap(day, F.col("date")), "_again": day == F.col("date")})
    extreme = F.col("_move") > config.extreme_move_pct
    gap = F.col("_gap") > config.max_gap_business_days
    return rows.groupBy("scheme_code").agg(
        F.max_by("scheme_name", "date").alias("scheme_name"),
        F.max_by("data_source", "date").alias("data_source"),
        F.count("*").alias("observations"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count_if(F.col("nav").isNull() | (F.col("nav") <= 0)).alias("bad_nav"),
        F.count_if("_again").alias("duplicates"),
        F.count_if(F.col("date") > F.lit(today)).alias("future"),
        F.count_if(extreme).alias("extreme"),
        F.max("_move").alias("worst_move"),
        F.max_by("date", F.struct("_move", F.datediff(F.lit(today), "date"))).alias("worst_date"),
        F.count_if(gap).alias("gaps"),
        F.max("_gap").alias("largest_gap"),
    ).withColumns({
        "staleness_days": F.datediff(F.lit(today), "last_date"),
        "history_years": F.datediff("last_date", "first_date") / DAYS_PER_YEAR,
    })


def _say(*parts: object) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def findings(raw: DataFrame, today: datetime.date, config: EngineConfig = DEFAULT, expected: DataFrame | None = None) -> DataFrame:
    """scheme_code, severity, check, message, affected_rows; expected: scheme_codes that should be there."""
    n, c = (lambda x: F.col(x).cast("string")), config
    known = F.col("observations") >= c.min_observations
    rules = [
        (F.col("bad_nav") > 0, "CRITICAL", "non_positive_nav", _say(n("bad_nav"), " rows without a positive NAV"), "bad_nav"),
        (F.col("duplicates") > 0, "CRITICAL", "duplicate_dates", _say(n("duplicates"), " repeated dates"), "duplicates"),
        (F.col("future") > 0, "CRITICAL", "future_dated", _say(n("future"), " rows dated in the future"), "future"),
        (~known, "CRITICAL", "insufficient_history", _say(n("observations"), f" observations, {c.min_observations} needed"), "observations"),
        (F.col("staleness_days") > c.max_staleness_days, "WARNING", "stale_data", _say("Last NAV is ", n("staleness_days"), " days old"), None),
        (F.col("extreme") > 0, "WARNING", "extreme_move", _say(n("extreme"), f" moves over {c.extreme_move_pct:.0f}%, worst on ", n("worst_date")), "extreme"),
        (F.col("gaps") > 0, "WARNING", "calendar_gap", _say(n("gaps"), f" gaps over {c.max_gap_business_days} business days, largest ", n("largest_gap")), "gaps"),
        (F.coalesce(F.col("scheme_name"), F.lit("")).rlike("^$|^Unknown scheme"), "WARNING", "missing_metadata", _say("No metadata row"), None),
        (F.col("data_source") == "synthetic", "WARNING", "synthetic_data", _say("Generated NAVs: not investable"), None),
        ((F.col("history_years") < 3) & known, "INFO", "short_history", _say(F.format_number("history_years", 1), " years of history"), None),
    ]
    rows = [
        F.when(cond, F.struct(
            F.lit(sev).alias("severity"), F.lit(check).alias("check"), msg.alias("message"),
            (F.col(k) if k else F.lit(0)).cast("long").alias("affected_rows"),
        ))
        for cond, sev, check, msg, k in rules
    ]
    seen, told = ingredients(raw, today, config), F.array_compact(F.array(*rows))
    if expected is not None:
        # a scheme that should be there and has no row has no observations
        seen = seen.join(expected.select("scheme_code").where("scheme_code is not null").distinct(), "scheme_code", "full_outer")
        absent = F.struct(
            F.lit("CRITICAL").alias("severity"), F.lit("no_data").alias("check"), F.lit("No NAV rows").alias("message"),
            F.lit(0).cast("long").alias("affected_rows"),
        )
        told = F.when(F.col("observations").isNull(), F.array(absent)).otherwise(told)
    return seen.select("scheme_code", F.explode(told).alias("f")).select("scheme_code", "f.*")


def coverage(raw: DataFrame, today: datetime.date, config: EngineConfig = DEFAULT) -> DataFrame:
    """A row a scheme: its days, with the name and source of the last.  Tasks put rows that differ by their day alone together
    before any is exchanged; texts are carried only by what is left, since an aggregate of texts has to sort its rows."""
    spans = raw.groupBy("scheme_code", "scheme_name", "data_source").agg(
        F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last")
    )
    found = spans.groupBy("scheme_code").agg(
        F.max_by("scheme_name", "last").alias("scheme_name"), F.max_by("data_source", "last").alias("data_source"),
        F.sum("n").alias("observations"), F.min("first").alias("first_date"), F.max("last").alias("last_date"),
    )
    years = F.datediff("last_date", "first_date") / DAYS_PER_YEAR
    return found.select(
        "scheme_code", "scheme_name", "observations", "first_date", "last_date",
        F.datediff(F.lit(today), "last_date").alias("staleness_days"), F.bround(years, 2).alias("history_years"), "data_source",
    )


def sorted_findings(found: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return found.orderBy(rank, "scheme_code", "check")


def unusable(found: DataFrame) -> DataFrame:
    return found.where("severity = 'CRITICAL'").select("scheme_code").distinct()


def summary(found: DataFrame, schemes: DataFrame) -> DataFrame:
    """One row: schemes checked, findings by severity, and schemes unusable."""
    counts = found.agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES],
        F.count_distinct(F.when(F.col("severity") == "CRITICAL", F.col("scheme_code"))).alias("unusable"),
    )
    # two rows of one value each
    return schemes.agg(F.count_distinct("scheme_code").alias("schemes")).join(F.broadcast(counts))


def usable(raw: DataFrame, found: DataFrame) -> DataFrame:
    """The panel without schemes that have a critical finding."""
    # a scheme has many rows, so its finding is what a task holds, and the rows are not sorted; not an anti join, which Spark
    # moves into the parts of a union, where each part would work the findings out again
    out = unusable(found).withColumn("_out", F.lit(True)).hint("shuffle_hash")
    return raw.join(out, "scheme_code", "left").where("_out is null").drop("_out")
