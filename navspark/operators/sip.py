"""Monthly investing: instalments, units and their internal rate of return, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, MIN_OBS_VOLATILITY, EngineConfig
from ..functions.expr import by_scheme

LOW, HIGH, STEPS = -0.9999, 10.0, 80
GUESS, NEWTON_STEPS = 0.1, 100
SIP_DAYS = 1096


def month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def trades(prev: str = "prev", first: str = "first", last: str = "last", rows: str = "obs") -> Column:
    """The instalments that trade on a row; NULL where none does.  Columns: the row's date, that of the row before it, and the
    first date, last date and number of rows of its scheme.

    Each instalment trades on the first trading day at or after the first of a month, so a row's are the month starts after
    the row before it, and no forward join is needed.  Those that would trade on the last day are skipped, and schemes that
    start after the period begins have none.
    """
    start = F.date_sub(last, SIP_DAYS)
    before = F.add_months(F.trunc(start, "MM"), -1)
    low = F.greatest(F.coalesce(F.trunc(prev, "MM"), before), before)
    n = month_number(F.col("date")) - month_number(low)
    return F.when((F.col(first) <= start) & (F.col(rows) >= MIN_OBS_VOLATILITY) & (n > 0) & (F.col("date") < F.col(last)), n)


def instalments(nav: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Rows on which instalments trade: n of them."""
    whole = Window.partitionBy("scheme_code")
    rows = nav.select(
        "scheme_code", "date", "nav", F.lag("date").over(by_scheme()).alias("prev"),
        F.min("date").over(whole).alias("first"), F.max("date").over(whole).alias("last"), F.count("*").over(whole).alias("obs"),
    )
    return rows.withColumn("n", trades()).where("n is not null")


def sip_units(nav: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """instalments and units bought, a row a scheme."""
    return instalments(nav, config).groupBy("scheme_code").agg(
        F.sum("n").cast("long").alias("instalments"), F.sum(F.col("n") * config.sip_amount / F.col("nav")).alias("units")
    )


def npv(rate: Column, flows: Column) -> Column:
    """The value of (years, amount) flows at an annual rate, and how it changes with the rate."""
    none = F.struct(F.lit(0.0).alias("value"), F.lit(0.0).alias("slope"))

    def add(s: Column, x: Column) -> Column:
        worth = x["amount"] * F.pow(1 + rate, -x["years"])
        return F.struct((s["value"] + worth).alias("value"), (s["slope"] - x["years"] * worth / (1 + rate)).alias("slope"))

    return F.aggregate(flows, none, add)


def newton(flows: Column) -> Column:
    """The rate that Newton's steps from GUESS reach; NULL where a step has no finite end above LOW, or after NEWTON_STEPS."""
    begin = F.struct(F.lit(GUESS).alias("rate"), F.lit(False).alias("found"), F.lit(False).alias("lost"))

    def step(s: Column, _: Column) -> Column:
        # the value at the rate is worked out once a step, inside a lambda of one element
        def judge(at: Column) -> Column:
            move = F.try_divide(at["value"], at["slope"])
            there = s["rate"] - move
            here = F.abs(at["value"]) < 1e-9
            lost = ~here & (move.isNull() | F.isnan(at["slope"]) | (F.abs(at["slope"]) == float("inf")) | F.isnan(there) | (F.abs(there) == float("inf")) | (there <= LOW))
            return F.struct(
                F.when(here | lost, s["rate"]).otherwise(there).alias("rate"),
                (here | (~lost & (F.abs(move) < 1e-10))).alias("found"),
                lost.alias("lost"),
            )

        return F.when(s["found"] | s["lost"], s).otherwise(F.transform(F.array(npv(s["rate"], flows)), judge)[0])

    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), begin, step, lambda s: F.when(s["found"], s["rate"]))


def bisection(flows: Column) -> Column:
    """The rate between LOW and HIGH where the value changes its sign; NULL where it does not."""

    def sign(rate: Column) -> Column:
        return F.signum(npv(rate, flows)["value"])

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        left = sign(mid) == s["sign"]
        return F.struct(F.when(left, mid).otherwise(s["lo"]).alias("lo"), F.when(left, s["hi"]).otherwise(mid).alias("hi"), s["sign"].alias("sign"))

    begin = F.struct(F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi"), sign(F.lit(LOW)).alias("sign"))
    root = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), begin, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when(sign(F.lit(LOW)) * sign(F.lit(HIGH)) <= 0, root)


def xirr(flows: Column) -> Column:
    """The annual rate at which an array of (years, amount) is worth nothing: by Newton's steps, behind them by bisection.

    NULL for fewer than two flows, for flows all in or all out, and where neither finds a rate.
    """
    both = F.exists(flows, lambda x: x["amount"] > 0) & F.exists(flows, lambda x: x["amount"] < 0)
    return F.when((F.size(flows) >= 2) & both, F.coalesce(newton(flows), bisection(flows)))


def plan_aggs(n: str, config: EngineConfig = DEFAULT) -> list[Column]:
    """Aggregates of the rows' instalments: the first day, what was paid in when, and the units bought."""
    trade = F.col(n).isNotNull()
    paid = F.struct("date", (-F.col(n) * config.sip_amount).alias("amount"))
    return [
        F.min(F.when(trade, F.col("date"))).alias("sip_from"), F.array_sort(F.collect_list(F.when(trade, paid))).alias("sip_paid"),
        F.sum(F.when(trade, F.col(n) * config.sip_amount / F.col("nav"))).alias("sip_units"),
    ]


def plan_rate(last: str, latest: str) -> Column:
    """sip_xirr_3y_pct from plan_aggs and the last day and its NAV, at which all is sold."""
    years = lambda day: F.datediff(day, F.col("sip_from")) / 365.0
    end = F.struct(years(F.col(last)).alias("years"), (F.col("sip_units") * F.col(latest)).alias("amount"))
    paid = F.transform("sip_paid", lambda x: F.struct(years(x["date"]).alias("years"), x["amount"].alias("amount")))
    rate = F.when(F.col("sip_from").isNotNull(), xirr(F.array_append(paid, end)))
    return (rate * 100).alias("sip_xirr_3y_pct")


def sip_xirr(nav: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """sip_xirr_3y_pct of a constant monthly amount over three years, sold at the last NAV."""
    whole = Window.partitionBy("scheme_code")
    rows = nav.select(
        "scheme_code", "date", "nav", F.lag("date").over(by_scheme()).alias("prev"),
        F.min("date").over(whole).alias("first"), F.max("date").over(whole).alias("last"), F.count("*").over(whole).alias("obs"),
    ).withColumn("n", trades())
    found = rows.groupBy("scheme_code").agg(F.max("last").alias("last"), F.max_by("nav", "date").alias("latest"), *plan_aggs("n", config))
    return found.where("sip_from is not null").select("scheme_code", plan_rate("last", "latest"))
