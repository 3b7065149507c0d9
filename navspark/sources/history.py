"""History payloads: JSON texts with an array of (date, nav) strings a scheme."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.expr import parse_date, parse_nav

LINES = "scheme_code string, payload string"
#: What orders restated days: later files win, then later places in a payload.
ORDER = ("file_time", "file_name", "seq")


def with_files(lines: DataFrame) -> DataFrame:
    """Payload lines of a file source with their file's time and name."""
    return lines.select(
        "scheme_code", "payload", F.col("_metadata.file_modification_time").alias("file_time"), F.col("_metadata.file_name").alias("file_name")
    )


def read(spark: SparkSession, landing: str) -> DataFrame:
    return with_files(spark.read.schema(LINES).json(landing))


def parse(payloads: DataFrame) -> DataFrame:
    """payloads: scheme_code, payload and what else orders them.  scheme_code, date, nav, seq and that of the good rows."""
    kind = schemas.HISTORY_PAYLOAD.simpleString()
    data = F.from_json("payload", f"struct<data: {kind}>")["data"]
    more = [c for c in payloads.columns if c not in ("scheme_code", "payload")]
    rows = payloads.select("scheme_code", *more, F.posexplode(data).alias("seq", "x"))
    rows = rows.select("scheme_code", parse_date(F.col("x.date")).alias("date"), parse_nav(F.col("x.nav")).alias("nav"), "seq", *more)
    return rows.where("date is not null and nav is not null")


def skipped(payloads: DataFrame) -> DataFrame:
    """scheme_code, rows and skipped."""
    kind = schemas.HISTORY_PAYLOAD.simpleString()
    total = payloads.select("scheme_code", F.size(F.from_json("payload", f"struct<data: {kind}>")["data"]).alias("rows"))
    good = parse(payloads).groupBy("scheme_code").agg(F.count("*").alias("good"))
    return total.join(good, "scheme_code", "left").select("scheme_code", "rows", (F.col("rows") - F.coalesce("good", F.lit(0))).alias("skipped"))
