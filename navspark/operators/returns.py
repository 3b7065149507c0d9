"""Point-to-point, daily and monthly returns, moving averages and rebased growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DAYS_PER_YEAR, DEFAULT, HORIZON_DAYS, LONG_WINDOW, SHORT_WINDOW
from ..functions.expr import by_scheme, cagr_pct


def daily_returns(nav: DataFrame) -> DataFrame:
    """scheme_code, date, nav, r; the first day of a scheme has none and is left out."""
    r = F.col("nav") / F.lag("nav").over(by_scheme()) - 1
    return nav.select("scheme_code", "date", "nav", r.alias("r")).where(F.col("r").isNotNull())


def monthly_returns(nav: DataFrame) -> DataFrame:
    """scheme_code, month, nav (the month's last), r; months without a NAV are skipped and spanned."""
    monthly = nav.groupBy("scheme_code", F.trunc("date", "MM").alias("month")).agg(F.max_by("nav", "date").alias("nav"))
    w = Window.partitionBy("scheme_code").orderBy("month")
    return monthly.withColumn("r", F.col("nav") / F.lag("nav").over(w) - 1).where(F.col("r").isNotNull())


def horizon_starts(value: str = "nav") -> list[Column]:
    """Aggregates: NAV and date of the last day at or before each horizon's target, given a column last_date."""
    out = []
    for name, days in HORIZON_DAYS.items():
        due = F.col("date") <= F.date_sub("last_date", days)
        out += [
            F.max_by(F.when(due, F.col(value)), F.when(due, F.col("date"))).alias(f"{value}_{name}"),
            F.max(F.when(due, F.col("date"))).alias(f"date_{name}"),
        ]
    return out


def trailing(name: str, start: Column, start_date: Column, end: Column, end_date: Column) -> Column:
    """Absolute under a year, annualised over the actual days from a year on."""
    days = HORIZON_DAYS[name]
    if days < 365:
        return F.when(start > 0, (end / start - 1) * 100)
    years = F.datediff(end_date, start_date) / DAYS_PER_YEAR
    return F.when(years >= 0.75 * days / DAYS_PER_YEAR, cagr_pct(start, end, years))


def with_last_date(nav: DataFrame) -> DataFrame:
    whole = Window.partitionBy("scheme_code")
    return nav.withColumn("last_date", F.max("date").over(whole))


TRAILING = {"3m": "return_3m_pct", "6m": "return_6m_pct", "1y": "return_1y_pct", "3y": "cagr_3y_pct", "5y": "cagr_5y_pct"}


def trailing_columns() -> list[Column]:
    """From horizon_starts() and the columns end and end_date."""
    ends = F.col("end"), F.col("end_date")
    return [trailing(h, F.col(f"nav_{h}"), F.col(f"date_{h}"), *ends).alias(n) for h, n in TRAILING.items()]


def trailing_returns(nav: DataFrame) -> DataFrame:
    """return_3m_pct, return_6m_pct, return_1y_pct, cagr_3y_pct, cagr_5y_pct: one window and one aggregation."""
    found = with_last_date(nav).groupBy("scheme_code").agg(
        F.max("last_date").alias("end_date"), F.max_by("nav", "date").alias("end"), *horizon_starts()
    )
    return found.select("scheme_code", *trailing_columns())


def since_inception(nav: DataFrame) -> DataFrame:
    found = nav.groupBy("scheme_code").agg(
        F.count("*").alias("n"), F.min_by("nav", "date").alias("start"), F.max_by("nav", "date").alias("end"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )
    years = F.datediff("last_date", "first_date") / DAYS_PER_YEAR
    cagr = F.when(F.col("n") >= 2, cagr_pct(F.col("start"), F.col("end"), years))
    return found.select("scheme_code", cagr.alias("since_inception_cagr_pct"))


def moving_averages(nav: DataFrame) -> DataFrame:
    """The panel with sma_50 and sma_200, NULL until their window is full."""
    w = by_scheme()
    n = F.row_number().over(w)
    sma = lambda k: F.when(n >= k, F.avg("nav").over(w.rowsBetween(1 - k, 0)))
    return nav.withColumns({"sma_50": sma(SHORT_WINDOW), "sma_200": sma(LONG_WINDOW)})


def last_averages(n: str, rows: str) -> list[Column]:
    """Aggregates sma_50 and sma_200 of a scheme's last day, as moving_averages has them there; given its rows' numbers by day,
    from 1, and how many they are.  Averages of the other days' windows are not worked out."""
    recent = lambda k: F.avg(F.when((F.col(rows) >= k) & (F.col(n) > F.col(rows) - k), F.col("nav")))
    return [recent(SHORT_WINDOW).alias("sma_50"), recent(LONG_WINDOW).alias("sma_200")]


def signal_columns(last: str = "x") -> list[Column]:
    """From the last row's struct of nav, sma_50 and sma_200."""
    nav, sma = F.col(f"{last}.nav"), F.col(f"{last}.sma_50")
    signal = F.when(sma.isNull(), "INSUFFICIENT_HISTORY").when(nav >= sma, "BULLISH").otherwise("BEARISH")
    return [
        nav.alias("latest_nav"), sma.alias("sma_50"), F.col(f"{last}.sma_200").alias("sma_200"),
        signal.alias("sma_signal"), ((nav / sma - 1) * 100).alias("nav_vs_sma50_pct"),
    ]


def sma_signal(nav: DataFrame) -> DataFrame:
    """latest_nav, sma_50, sma_200, sma_signal and nav_vs_sma50_pct at the last day."""
    last = moving_averages(nav).groupBy("scheme_code").agg(
        F.max_by(F.struct("nav", "sma_50", "sma_200"), "date").alias("x")
    )
    return last.select("scheme_code", *signal_columns())


def growth(nav: DataFrame, base: float = DEFAULT.growth_base) -> DataFrame:
    """Growth of the base amount from the first day on which every scheme has started."""
    start = nav.groupBy("scheme_code").agg(F.min("date").alias("d")).agg(F.max("d").alias("common"))
    common = nav.join(F.broadcast(start), F.col("date") >= F.col("common")).drop("common")  # one row
    first = F.first("nav").over(by_scheme().rowsBetween(Window.unboundedPreceding, 0))
    return common.select("scheme_code", "date", (F.col("nav") / first * base).alias("growth"))


def decimate(series: DataFrame, points: int = 700) -> DataFrame:
    """At most about so many points a scheme, and always the last."""
    whole = Window.partitionBy("scheme_code")
    numbered = series.withColumns({"_i": F.row_number().over(by_scheme()), "_n": F.count("*").over(whole)})
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / points))
    return numbered.where(((F.col("_i") - 1) % step == 0) | (F.col("_i") == F.col("_n"))).drop("_i", "_n")
