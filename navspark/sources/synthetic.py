"""Generated NAVs for offline runs: a seeded geometric walk on business days, always tagged synthetic."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DAYS_PER_YEAR, TRADING_DAYS

DRIFT, VOLATILITY, FLOOR = 0.12, 0.15, 0.01


def generate(schemes: DataFrame, end: datetime.date, years: float = 5.0, seed: int = 42) -> DataFrame:
    """schemes: scheme_code.  scheme_code, date, nav, data_source; the same for the same arguments."""
    start = end - datetime.timedelta(days=round(years * DAYS_PER_YEAR))
    days = schemes.select("scheme_code", F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))).alias("date"))
    days = days.where(F.weekday("date") < 5)
    uniform = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "scheme_code", "date"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(2))
    step = F.log(1 + DRIFT / TRADING_DAYS + normal * (VOLATILITY / math.sqrt(TRADING_DAYS)))
    w = Window.partitionBy("scheme_code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    base = 10 + 90 * (F.pmod(F.xxhash64(F.lit(seed), "scheme_code"), F.lit(1 << 20)) / float(1 << 20))
    nav = F.round(F.greatest(base * F.exp(F.sum(step).over(w)), F.lit(FLOOR)), 4)
    return days.select("scheme_code", "date", nav.alias("nav"), F.lit("synthetic").alias("data_source"))
