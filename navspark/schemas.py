"""Explicit schemas of the stored tables and parsed records."""

from __future__ import annotations

import datetime
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 3


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


NAV_PANEL = _struct(
    scheme_code=T.StringType(), scheme_name=T.StringType(), fund_house=T.StringType(),
    scheme_category=T.StringType(), date=T.DateType(), nav=T.DoubleType(), data_source=T.StringType(),
)
SCHEME_INFO = _struct(
    scheme_code=T.StringType(), scheme_name=T.StringType(), fund_house=T.StringType(), scheme_type=T.StringType(),
    scheme_category=T.StringType(), isin_growth=T.StringType(), isin_reinvest=T.StringType(),
    data_source=T.StringType(), updated_at=T.TimestampType(),
)
NAV_HISTORY = _struct(
    scheme_code=T.StringType(), date=T.DateType(), nav=T.DoubleType(), data_source=T.StringType(),
    updated_at=T.TimestampType(),
)
RUN_EVENTS = _struct(
    run_id=T.StringType(), seq=T.LongType(), kind=T.StringType(), at=T.TimestampType(), schemes=T.StringType(),
    rows_written=T.LongType(), rows_updated=T.LongType(), data_source=T.StringType(), status=T.StringType(),
    message=T.StringType(),
)
CATALOGUE_ENTRY = _struct(
    scheme_code=T.StringType(), scheme_name=T.StringType(), fund_house=T.StringType(), scheme_type=T.StringType(),
    scheme_category=T.StringType(), isin_growth=T.StringType(), isin_reinvest=T.StringType(), nav=T.DoubleType(),
    nav_date=T.DateType(),
)
HISTORY_PAYLOAD = T.ArrayType(_struct(date=T.StringType(), nav=T.StringType()))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Additive evolution: the schema's columns, absent ones as typed NULLs ('unknown' for data_source)."""
    columns = []
    for f in schema.fields:
        default = F.lit("unknown") if f.name == "data_source" else F.lit(None)
        columns.append((F.col(f.name) if f.name in df.columns else default).cast(f.dataType).alias(f.name))
    return df.select(*columns)


def as_json(schema: T.StructType, row: Mapping[str, object]) -> str:
    """A line that Spark's JSON reader takes for a row of the schema."""

    def plain(value: object) -> object:
        return value.isoformat() if isinstance(value, datetime.date) else value

    return json.dumps({f.name: plain(row.get(f.name)) for f in schema.fields if row.get(f.name) is not None})
