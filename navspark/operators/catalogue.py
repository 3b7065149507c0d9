"""Catalogue queries: search, coverage, statistics, and the queue of schemes that lack history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_OBSERVATIONS = 30


def counts(nav: DataFrame) -> DataFrame:
    return nav.groupBy("scheme_code").agg(
        F.count("*").alias("observations"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.max("data_source").alias("data_source"),
    )


def scheme_coverage(info: DataFrame, nav: DataFrame) -> DataFrame:
    """Every scheme with its NAV count and days; the NAVs are aggregated before the join, so none is lost or repeated."""
    rows = info.join(counts(nav), "scheme_code", "left")
    return rows.withColumn("observations", F.coalesce("observations", F.lit(0))).orderBy(
        F.col("fund_house").asc_nulls_first(), "scheme_name", "scheme_code"
    )


def search(
    info: DataFrame,
    nav: DataFrame,
    query: str | None = None,
    category: str | None = None,
    fund_house: str | None = None,
    with_history_only: bool = False,
    limit: int = 200,
) -> DataFrame:
    """Schemes by a part of the name (LIKE, no regard to case), exact category and house; most observed first."""
    if query:
        info = info.where(F.col("scheme_name").ilike(f"%{query}%"))
    if category:
        info = info.where(F.col("scheme_category") == category)
    if fund_house:
        info = info.where(F.col("fund_house") == fund_house)
    rows = info.join(counts(nav).select("scheme_code", "observations", "last_date"), "scheme_code", "left")
    rows = rows.withColumn("observations", F.coalesce("observations", F.lit(0)))
    if with_history_only:
        rows = rows.where(F.col("observations") >= MIN_OBSERVATIONS)
    return rows.orderBy(F.col("observations").desc(), "scheme_name", "scheme_code").limit(limit)


def statistics(info: DataFrame, nav: DataFrame) -> DataFrame:
    """One row: schemes, categories, fund_houses, analysable and nav_rows."""
    dims = info.agg(
        F.count_distinct("scheme_code").alias("schemes"), F.count_distinct("scheme_category").alias("categories"),
        F.count_distinct("fund_house").alias("fund_houses"),
    )
    facts = nav.groupBy("scheme_code").count().agg(
        F.count_if(F.col("count") >= MIN_OBSERVATIONS).alias("analysable"), F.coalesce(F.sum("count"), F.lit(0)).alias("nav_rows")
    )
    return dims.join(F.broadcast(facts))  # one row each


def category_coverage(info: DataFrame, nav: DataFrame, top: int = 15) -> DataFrame:
    rows = info.join(counts(nav).select("scheme_code", "observations"), "scheme_code", "left")
    found = rows.groupBy("scheme_category").agg(
        F.count_distinct("scheme_code").alias("schemes"),
        F.sum(F.when(F.col("observations") >= MIN_OBSERVATIONS, 1).otherwise(0)).alias("analysable"),
    )
    return found.orderBy(F.col("schemes").desc(), F.col("scheme_category").asc_nulls_first()).limit(top)


def categories(info: DataFrame) -> DataFrame:
    return info.select("scheme_category").where(F.col("scheme_category").isNotNull()).distinct().orderBy("scheme_category")


def backfill_queue(info: DataFrame, nav: DataFrame, category: str | None = None, fund_house: str | None = None, limit: int = 100) -> DataFrame:
    """Schemes with too few observations: open-ended types first, then interval ones, then others; fullest first."""
    if category:
        info = info.where(F.col("scheme_category") == category)
    if fund_house:
        info = info.where(F.col("fund_house") == fund_house)
    rows = info.join(counts(nav).select("scheme_code", "observations"), "scheme_code", "left")
    rows = rows.withColumn("observations", F.coalesce("observations", F.lit(0)))
    kind = F.when(F.col("scheme_type").startswith("Open Ended"), 0).when(F.col("scheme_type").startswith("Interval"), 1).otherwise(2)
    rows = rows.where(F.col("observations") < MIN_OBSERVATIONS).withColumn("priority", kind)
    return rows.orderBy("priority", F.col("observations").desc(), "scheme_code").limit(limit)
