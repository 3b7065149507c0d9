"""Column expressions shared by sources and operators."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Tokens that stand for a missing value (fixed values).
MISSING_TOKENS = ["", "-", "n.a.", "na", "n/a", "null", "none"]
#: Date patterns, in the order tried (fixed values).
DATE_PATTERNS = ["dd-MMM-yyyy", "dd-MMMM-yyyy", "dd-MM-yyyy", "yyyy-MM-dd"]


def clean_text(c: Column) -> Column:
    """Trimmed text; NULL for a missing-value token."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin(MISSING_TOKENS), t)


def parse_nav(c: Column) -> Column:
    """A positive number, else NULL."""
    v = clean_text(c).try_cast("double")
    return F.when((v > 0) & ~F.isnan(v), v)


def parse_date(c: Column) -> Column:
    t = clean_text(c)
    return F.coalesce(*[F.try_to_date(t, p) for p in DATE_PATTERNS])


def by_scheme() -> WindowSpec:
    """Rows of a scheme in the order of days; every ordered window of the engine uses this one."""
    return Window.partitionBy("scheme_code").orderBy(F.unix_date("date"))


def finite(c: Column) -> Column:
    """NULL for NaN and infinities, so that neither enters a frame."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def weekdays_before(day: Column) -> Column:
    """Mondays to Fridays before a day given as days since the epoch, from a fixed origin."""
    x = day - 4
    return 5 * F.floor(x / 7) + F.least(F.pmod(x, F.lit(7)), F.lit(5))


def business_gap(previous: Column, current: Column) -> Column:
    """Business days missing between two neighbouring observations."""
    a, b = F.unix_date(previous), F.unix_date(current)
    return (weekdays_before(b + 1) - weekdays_before(a) - 2).cast("int")


def share_pct(condition: Column) -> Column:
    """Share of rows, in percent, over rows where the condition is known."""
    return F.avg(F.when(condition, 1.0).when(~condition, 0.0)) * 100


def cagr_pct(start: Column, end: Column, years: Column) -> Column:
    ok = (start > 0) & (end > 0) & (years >= 1 / 12)
    return F.when(ok, (F.pow(end / start, 1 / years) - 1) * 100)
