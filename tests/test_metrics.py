"""Closed-form answers of the metric operators."""

from __future__ import annotations

import datetime
import math
import statistics

import pytest
from pyspark.sql import functions as F
from trading_days import business_days

from navspark.config import EngineConfig
from navspark.operators import benchmark as bm
from navspark.operators import returns, risk, rolling, sip
from navspark.panel import clean_series
from navspark.plans import bundle


def compounding(n=1200, rate=0.10, start="2019-01-01"):
    days = business_days(start, n)
    return [(d, 100 * (1 + rate) ** ((d - days[0]).days / 365.25)) for d in days]


def wobbling(n=900, scale=0.01):
    nav, out = 100.0, []
    for i, d in enumerate(business_days("2019-01-01", n)):
        nav *= 1 + scale * math.sin(i * 1.7) + scale / 10
        out.append((d, nav))
    return out


@pytest.fixture(scope="module")
def nav(series):
    up = [100 + i / 6 for i in range(120)]
    fall = [*[100 + i * 0.5 for i in range(40)], 120, *[120 - i for i in range(1, 31)], *[90 + i * 0.9 for i in range(60)]]
    return series(
        flat=[(d, 100) for d in business_days("2020-01-01", 300)],
        ten=compounding(),
        dip=list(zip(business_days("2020-01-01", len(fall)), fall)),
        under=list(zip(business_days("2024-01-01", 60), [100 + i * 50 / 29 for i in range(30)] + [150 - i * 30 / 29 for i in range(30)])),
        young=list(zip(business_days("2024-05-27", 25), [100 + i / 6 for i in range(25)])),
        wob=wobbling(),
        few=list(zip(business_days("2024-01-01", 3), up)),
    )


def by_code(df):
    return {r.scheme_code: r for r in df.collect()}


def test_clean_series_last_duplicate_wins_then_bad_rows_go(spark):
    day = lambda n: datetime.date(2024, 1, n)
    rows = [("a", day(3), 103.0, 0), ("a", day(1), 101.0, 1), ("a", day(2), 102.0, 2), ("a", day(2), 102.5, 3), ("a", day(4), -5.0, 4),
            ("a", day(5), 9.0, 5), ("a", day(5), 0.0, 6), ("a", None, 1.0, 7), ("a", day(6), None, 8)]
    df = spark.createDataFrame(rows, "scheme_code string, date date, nav double, seq int")
    got = clean_series(df, "seq").orderBy("date").collect()
    assert [(r.date.day, r.nav) for r in got] == [(1, 101.0), (2, 102.5), (3, 103.0)]


def test_trailing_and_inception(nav):
    t, s = by_code(returns.trailing_returns(nav)), by_code(returns.since_inception(nav))
    assert t["ten"].return_6m_pct == pytest.approx(4.88, abs=0.15)
    assert t["ten"].return_1y_pct == pytest.approx(10, abs=0.1)
    assert t["ten"].cagr_3y_pct == pytest.approx(10, abs=0.01)
    assert t["ten"].cagr_5y_pct is None
    assert s["ten"].since_inception_cagr_pct == pytest.approx(10, abs=1e-6)
    assert s["few"].since_inception_cagr_pct is None


def test_volatility_sharpe_and_guards(nav):
    config = EngineConfig(risk_free=0.065)
    got = by_code(risk.return_moments(nav, config))
    assert got["flat"].volatility_pct == 0 and got["flat"].sharpe_ratio is None
    assert got["few"].volatility_pct is None
    r = [b[1] / a[1] - 1 for a, b in zip(wobbling(), wobbling()[1:])]
    rd, sd = config.daily_risk_free, statistics.stdev(r)
    assert got["wob"].volatility_pct == pytest.approx(sd * math.sqrt(252) * 100)
    assert got["wob"].sharpe_ratio == pytest.approx((statistics.mean(r) - rd) / sd * math.sqrt(252))
    down = math.sqrt(sum(min(x - rd, 0) ** 2 for x in r) / len(r)) * math.sqrt(252) * 100
    assert got["wob"].downside_deviation_pct == pytest.approx(down)
    assert got["wob"].sortino_ratio == pytest.approx((statistics.mean(r) - rd) * 252 * 100 / down)


def test_positive_days_count_zero(series):
    points = [100, 101, 99.99, 99.99, 101.9898]
    got = risk.return_moments(series(x=list(zip(business_days("2024-01-01", 5), points)))).first()
    assert got.positive_days_pct == 75


def test_tail_risk_matches_interpolated_quantile(nav):
    r = sorted(b[1] / a[1] - 1 for a, b in zip(wobbling(), wobbling()[1:]))
    at = 0.05 * (len(r) - 1)
    q = r[int(at)] + (at - int(at)) * (r[int(at) + 1] - r[int(at)])
    got = by_code(risk.tail_risk(nav))["wob"]
    assert got.var_95_pct == pytest.approx(abs(q) * 100)
    assert got.cvar_95_pct == pytest.approx(abs(statistics.mean(x for x in r if x <= q)) * 100)


def test_max_drawdown(nav):
    got = by_code(risk.max_drawdown(nav))
    assert (got["flat"].max_drawdown_pct, got["flat"].max_drawdown_peak, got["flat"].max_drawdown_days, got["flat"].max_drawdown_recovered) == (0, None, 0, True)
    dip = got["dip"]
    assert dip.max_drawdown_pct == pytest.approx(-25)
    assert dip.max_drawdown_peak < dip.max_drawdown_trough < dip.max_drawdown_recovery and dip.max_drawdown_recovered
    assert got["under"].max_drawdown_pct == pytest.approx(-20) and got["under"].max_drawdown_recovery is None
    assert by_code(risk.current_drawdown(nav))["under"].current_drawdown_pct == pytest.approx(-20)


def test_rolling_windows(nav):
    got = rolling.rolling_stats(nav.where("scheme_code = 'ten'"), 2.0).first()
    assert got.rolling_3y_min_pct == pytest.approx(10, abs=0.01) and got.rolling_3y_max_pct == pytest.approx(10, abs=0.01)
    assert got.rolling_3y_beat_hurdle_pct == 100
    assert rolling.rolling_stats(nav, 2.0, EngineConfig(risk_free=0.20)).where("scheme_code = 'ten'").first().rolling_3y_beat_hurdle_pct == 0
    assert rolling.rolling_stats(nav, 10.0).count() == 0


def test_benchmark_of_itself_and_of_a_levered_fund(series):
    base = wobbling(900)
    r = [b[1] / a[1] - 1 for a, b in zip(base, base[1:])]
    lev = [(base[0][0], 100.0)]
    for (d, _), x in zip(base[1:], r):
        lev.append((d, lev[-1][1] * (1 + 2 * x)))
    nav = series(b=base, same=base, lev=lev, brief=base[:30])
    config = EngineConfig(risk_free=0.0)
    aligned = bm.align(nav, "b")
    got = by_code(bm.regression(aligned, config))
    assert "b" not in got
    assert (got["same"].beta, got["same"].r_squared) == (pytest.approx(1), pytest.approx(1))
    assert got["same"].alpha_pct == pytest.approx(0, abs=1e-9) and got["same"].tracking_error_pct == pytest.approx(0, abs=1e-9)
    assert got["lev"].beta == pytest.approx(2, abs=0.02) and got["lev"].r_squared == pytest.approx(1)
    assert (got["brief"].overlap_days, got["brief"].beta) == (29, None)
    capture = by_code(bm.capture_ratios(aligned))
    assert capture["same"].up_capture_pct == pytest.approx(100)
    assert by_code(bm.excess_1y(aligned))["same"].excess_return_1y_pct == pytest.approx(0)


def test_xirr(spark):
    d = datetime.date
    flows = {
        "double": [(d(2023, 1, 1), -1000), (d(2024, 1, 1), 2000)],
        "even": [(d(2023, 1, 1), -1000), (d(2024, 1, 1), 1000)],
        "bad": [(d(2023, 1, 1), -1000), (d(2024, 1, 1), -1)],
        "one": [(d(2023, 1, 1), -1000)],
        "mixed": [(d(2022, 1, 1), -1000), (d(2022, 7, 15), -500), (d(2023, 3, 2), -750), (d(2024, 1, 1), 2500)],
        "steep": [(d(2023, 1, 1), -1), (d(2024, 1, 1), 100)],  # 9,900 %, beyond the bracket
        "ruin": [(d(2023, 1, 1), -100), (d(2024, 1, 1), 1)],  # Newton's first step falls below -1
        "never": [(d(2022, 1, 1), -1), (d(2023, 1, 1), 3), (d(2024, 1, 1), -2.5)],  # worth less than nothing at any rate
        "ins": [(d(2023, 1, 1), 5), (d(2024, 1, 1), 7)],
    }
    rows = [(k, [((x - f[0][0]).days / 365, float(a)) for x, a in f]) for k, f in flows.items()]
    df = spark.createDataFrame(rows, "k string, f array<struct<years: double, amount: double>>")
    got = dict(df.select("k", sip.xirr(F.col("f"))).collect())
    assert got["double"] == pytest.approx(1.0) and got["even"] == pytest.approx(0, abs=1e-9)
    assert got["bad"] is None and got["one"] is None and got["never"] is None and got["ins"] is None
    assert got["steep"] == pytest.approx(99.0) and got["ruin"] == pytest.approx(-0.99)
    ways = {r.k: (r.n, r.b) for r in df.select("k", sip.newton(F.col("f")).alias("n"), sip.bisection(F.col("f")).alias("b")).collect()}
    assert ways["ruin"][0] is None and ways["steep"][1] is None and ways["double"] == pytest.approx((1.0, 1.0))
    npv = sum(a * (1 + got["mixed"]) ** -((x - d(2022, 1, 1)).days / 365) for x, a in flows["mixed"])
    assert npv == pytest.approx(0, abs=1e-4)


def test_sip(nav):
    got = by_code(sip.sip_xirr(nav))
    assert got["ten"].sip_xirr_3y_pct == pytest.approx(10, abs=1)
    assert "young" not in got
    units = by_code(sip.sip_units(nav))
    assert 36 <= units["ten"].instalments <= 37


def test_moving_averages_do_not_cross_schemes(nav):
    got = returns.moving_averages(nav)
    assert got.groupBy("scheme_code").agg(F.count("sma_50").alias("n")).where("scheme_code = 'flat'").first().n == 251
    signals = by_code(returns.sma_signal(nav))
    assert signals["ten"].sma_signal == "BULLISH" and signals["under"].sma_signal == "BEARISH"
    assert (signals["young"].sma_signal, signals["young"].sma_50) == ("INSUFFICIENT_HISTORY", None)


def test_monthly_and_growth(series):
    days = [d for d in business_days("2024-01-01", 70) if d < datetime.date(2024, 4, 1)]
    points = [(d, 100 + 10 * i / (len(days) - 1)) for i, d in enumerate(days)]
    nav = series(m=points, late=points[10:])
    monthly = returns.monthly_returns(nav).where("scheme_code = 'm'").collect()
    assert len(monthly) == 2 and all(r.r > 0 for r in monthly)
    grown = returns.growth(nav, 10_000).orderBy("date").collect()
    assert grown[0].date == days[10] and grown[0].growth == 10_000
    assert returns.decimate(returns.growth(nav), 10).where("scheme_code = 'm'").count() <= 12


def test_bundle_agrees_with_families(nav):
    got = by_code(bundle.scheme_metrics(nav, "wob"))
    assert len(got) == 7
    assert got["young"].volatility_pct is not None and got["young"].cagr_3y_pct is None and got["young"].notes
    assert got["wob"].beta is None and got["ten"].beta is not None
    dd = by_code(risk.max_drawdown(nav))
    for code, row in dd.items():
        assert got[code].max_drawdown_pct == pytest.approx(row.max_drawdown_pct)
    assert got["ten"].calmar_ratio is None and got["ten"].max_drawdown_pct == 0
    assert bundle.rounded(bundle.scheme_metrics(nav)).where("scheme_code = 'ten'").first().cagr_3y_pct == 10.0


def test_bundle_sorts_a_spread_panel_once_and_averages_the_last_days_only(series):
    days = business_days("2021-01-04", 260)
    nav = series(**{f"n{n}": [(d, 100 + i % 7 + i / 9) for i, d in enumerate(days[:n])] for n in (49, 50, 199, 200, 260)})
    last, got = by_code(returns.sma_signal(nav)), by_code(bundle.scheme_metrics(nav))
    columns = ["latest_nav", "sma_50", "sma_200", "sma_signal", "nav_vs_sma50_pct"]
    assert [[got[c][x] for x in columns if x in got[c]] for c in last] == [[last[c][x] for x in columns if x in got[c]] for c in last]
    plan = bundle.scheme_metrics(nav.repartition(8, "scheme_code"))._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Sort ["), plan.count("Exchange "), plan.count("specifiedwindowframe(RowFrame, -199")) == (1, 1, 0)
