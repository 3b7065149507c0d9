"""The NAV panel: loading, cleaning, and the adapter that derives one from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a task is given at most where a panel is spread by scheme, but for a scheme's own.
TASK_ROWS = 250_000


def selected(nav: DataFrame, scheme_codes: list[str] | None) -> DataFrame:
    """The rows of some schemes; None and an empty list mean every scheme, here and wherever codes are given."""
    return nav.where(F.col("scheme_code").isin(scheme_codes)) if scheme_codes else nav


def load_panel(nav: DataFrame, info: DataFrame, scheme_codes: list[str] | None = None) -> DataFrame:
    """NAV rows of the selected schemes with their metadata; unknown schemes stay, named by their code."""
    nav = selected(nav, scheme_codes)
    meta = info.select("scheme_code", "scheme_name", "fund_house", "scheme_category")
    name = F.coalesce("scheme_name", F.concat(F.lit("Unknown scheme "), "scheme_code"))
    return nav.join(meta, "scheme_code", "left").select(
        "scheme_code", name.alias("scheme_name"), "fund_house", "scheme_category", "date", "nav", "data_source"
    )


def clean_series(raw: DataFrame, *order: str) -> DataFrame:
    """One row a scheme and date: the last in input order, given by the order columns; then positive NAVs only (so a
    bad last duplicate removes its date).  NaN is no NAV, like NULL."""
    known = raw.where(F.col("date").isNotNull() & F.col("nav").isNotNull() & ~F.isnan("nav"))
    last = Window.partitionBy("scheme_code", "date").orderBy(*[F.col(c).desc() for c in order])
    kept = known.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", *[c for c in order if c != "nav"])
    return kept.where("nav > 0")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def price(cents: Column, quantity: Column) -> Column:
    """Price per unit to four decimals, half up, in whole numbers, so that no engine's rounding of a tie shows."""
    return F.call_function("div", cents * 200 + quantity, quantity * 2) / 10000.0


def whole(c: str, scale: int = 1) -> Column:
    return F.round(F.col(c) * scale).cast("long")


def tasks(rows: DataFrame) -> int:
    """Partitions to spread rows over by scheme: those of the session's shuffles, more where one would hold over TASK_ROWS.
    Unlike a number that is left to Spark, it does not put partitions together until they have 64 MB, which sorts and hash
    tables hold several times over."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))


def star_tasks(spark: SparkSession, sf_dir: str) -> int:
    return tasks(_table(spark, sf_dir, "lineitem"))


def star_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scheme_code, date, nav, data_source: each supplier's daily volume-weighted price, to four decimals.

    Lines are exchanged once, by scheme: nearly every line is a day of its own, so that sums before the exchange would save
    nothing, and what follows a scheme through its days needs no exchange.
    """
    lines = _table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("scheme_code"), F.col("l_shipdate").cast("date").alias("date"),
        whole("l_extendedprice", 100).alias("cents"), whole("l_quantity").alias("quantity"),
    )
    spread = lines.repartition(star_tasks(spark, sf_dir), "scheme_code")
    daily = spread.groupBy("scheme_code", "date").agg(price(F.sum("cents"), F.sum("quantity")).alias("nav"))
    source = F.when(F.col("scheme_code").cast("long") % 7 == 0, "synthetic").otherwise("amfi")
    return daily.select("scheme_code", "date", "nav", source.alias("data_source"))


def star_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-level prices: several rows a scheme and date, with their input order."""
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("scheme_code"),
        F.col("l_shipdate").cast("date").alias("date"),
        price(whole("l_extendedprice", 100), whole("l_quantity")).alias("nav"),
        F.col("l_orderkey").alias("s1"),
        F.col("l_linenumber").alias("s2"),
        F.col("l_extendedprice").alias("s3"),
    )


def star_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation, region = (_table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").cast("string").alias("scheme_code"),
            F.col("s_name").alias("scheme_name"),
            F.col("n_name").alias("fund_house"),
            F.col("r_name").alias("scheme_category"),
        )
    )


def event_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short series: each user's mean event value a day."""
    return (
        _table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").cast("string").alias("scheme_code"), F.col("ts").cast("date").alias("date"))
        .agg(F.round(F.avg("value"), 4).alias("nav"))
        .where("nav > 0")
        .withColumn("data_source", F.lit("amfi"))
    )
