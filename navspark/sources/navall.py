"""The positional catalogue feed: section lines, fund-house lines and semicolon-separated schemes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import clean_text, parse_date, parse_nav

#: A section line: type of schemes, then the category in brackets (fixed value of the format).
SECTION = r"^(.*?)\s*Schemes?\s*\((.*)\)\s*$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n, line: a file is read whole, so that its lines keep their order (a catalogue has some 14,000)."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (see schemas.CATALOGUE_ENTRY), the first of each code, and one row with the number of lines skipped.

    A section sets type and category and clears the house; any other line without a semicolon is a house; a scheme
    needs five fields, a numeric code and a name.
    """
    line = F.trim("line")
    rows = lines.select("file", "n", line.alias("line")).where("line != ''")
    is_data = F.col("line").contains(";")
    is_section = ~is_data & F.col("line").rlike(SECTION)
    upto = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "_section": F.sum(is_section.cast("int")).over(upto),
        "scheme_type": F.last(F.when(is_section, F.trim(F.regexp_extract("line", SECTION, 1))), True).over(upto),
        "scheme_category": F.last(F.when(is_section, F.trim(F.regexp_extract("line", SECTION, 2))), True).over(upto),
        "_data": is_data,
        "_house": F.when(~is_data & ~is_section, F.col("line")),
    })
    in_section = Window.partitionBy("file", "_section").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("fund_house", F.last("_house", True).over(in_section)).where("_data")
    f = F.split("line", ";")
    part = lambda i: F.get(f, i)
    good = (F.size(f) >= 5) & F.coalesce(F.trim(part(0)).rlike("^[0-9]+$"), F.lit(False)) & clean_text(part(3)).isNotNull()
    rows = rows.withColumns({"_good": good, "scheme_code": F.trim(part(0))})
    first = Window.partitionBy("scheme_code", "_good").orderBy("file", "n")
    rows = rows.withColumn("_keep", F.col("_good") & (F.row_number().over(first) == 1))
    entries = rows.where("_keep").select(
        "scheme_code", clean_text(part(3)).alias("scheme_name"), "fund_house", "scheme_type", "scheme_category",
        clean_text(part(1)).alias("isin_growth"), clean_text(part(2)).alias("isin_reinvest"),
        parse_nav(part(4)).alias("nav"), parse_date(part(5)).alias("nav_date"),
    )
    return entries, rows.agg(F.count_if(~F.col("_keep")).alias("skipped"))
