"""Quality gate, peer ranks, scores and screens."""

from __future__ import annotations

import datetime
import random
import statistics

import pytest
from trading_days import business_days

from navspark.config import EngineConfig
from navspark.operators import peers, screener, validation
from navspark.plans import insights

TODAY = business_days("2022-01-03", 400)[-1]


@pytest.fixture(scope="module")
def raw(spark):
    days = business_days("2022-01-03", 400)
    base = [(d, 100 + i / 8) for i, d in enumerate(days)]
    cases = {
        "clean": base,
        "zero": [(d, 0.0 if i == 5 else -3.0 if i == 9 else v) for i, (d, v) in enumerate(base)],
        "twice": [*base, base[7]],
        "ahead": [*base[:-1], (TODAY + datetime.timedelta(days=10), 150.0)],
        "brief": base[-10:],
        "stale": base[:370],
        "jump": [(d, v * 1.5 if i >= 100 else v) for i, (d, v) in enumerate(base)],
        "hole": base[:100] + base[130:],
        "noname": base,
        "made": base,
        "short": base[-200:],
        "nulls": [(d, None if i == 3 else v) for i, (d, v) in enumerate(base)],
    }
    rows = [
        (c, "Unknown scheme noname" if c == "noname" else f"Fund {c}", d, None if v is None else float(v), "synthetic" if c == "made" else "amfi")
        for c, points in cases.items()
        for d, v in points
    ]
    return spark.createDataFrame(rows, "scheme_code string, scheme_name string, date date, nav double, data_source string")


def checks(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.scheme_code, {})[r.check] = (r.severity, r.affected_rows)
    return out


def test_each_check_fires_alone(spark, raw):
    expected = spark.createDataFrame([("clean",), ("absent",)], "scheme_code string")
    got = checks(validation.findings(raw, TODAY, expected=expected))
    assert got["absent"] == {"no_data": ("CRITICAL", 0)}
    assert set(got["clean"]) == {"short_history"}
    assert got["zero"]["non_positive_nav"] == ("CRITICAL", 2)
    assert got["nulls"]["non_positive_nav"] == ("CRITICAL", 1)
    assert got["twice"]["duplicate_dates"] == ("CRITICAL", 1)
    assert got["ahead"]["future_dated"] == ("CRITICAL", 1)
    assert got["brief"]["insufficient_history"] == ("CRITICAL", 10) and "short_history" not in got["brief"]
    assert got["stale"]["stale_data"][0] == "WARNING"
    assert got["jump"]["extreme_move"] == ("WARNING", 1)
    assert got["hole"]["calendar_gap"] == ("WARNING", 1)
    assert got["noname"]["missing_metadata"][0] == "WARNING"
    assert got["made"]["synthetic_data"][0] == "WARNING"
    assert got["short"]["short_history"][0] == "INFO"


def test_thresholds_summary_and_exclusion(raw):
    strict = checks(validation.findings(raw, TODAY, EngineConfig(extreme_move_pct=60.0, min_observations=5)))
    assert "extreme_move" not in strict["jump"] and "insufficient_history" not in strict["brief"]
    found = validation.findings(raw, TODAY)
    one = validation.summary(found, raw).first()
    assert (one.schemes, one.unusable) == (12, 5)
    kept = {r.scheme_code for r in validation.usable(raw, found).select("scheme_code").distinct().collect()}
    assert kept == {"clean", "stale", "jump", "hole", "noname", "made", "short"}
    order = [r.severity for r in validation.sorted_findings(found).collect()]
    assert order == sorted(order, key=validation.SEVERITIES.index)
    assert validation.coverage(raw, TODAY).where("scheme_code = 'brief'").first().observations == 10


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_coverage_puts_days_together_before_it_sorts(spark, raw):
    day = datetime.date
    rows = [("a", "Old", day(2022, 1, 3), 1.0, "amfi"), ("a", "New", day(2022, 1, 5), 1.0, "synthetic"), ("a", "Old", day(2022, 1, 4), 1.0, "amfi"), ("a", None, None, None, "amfi")]
    one = validation.coverage(spark.createDataFrame(rows, "scheme_code string, scheme_name string, date date, nav double, data_source string"), TODAY).first()
    assert (one.scheme_name, one.data_source, one.observations, one.first_date, one.last_date) == ("New", "synthetic", 4, day(2022, 1, 3), day(2022, 1, 5))
    below = plan_of(validation.coverage(raw, TODAY)).rindex("Aggregate(key")
    assert plan_of(validation.coverage(raw, TODAY))[below - 4 : below] == "Hash"


def test_findings_sort_a_spread_panel_once(raw):
    plan = plan_of(validation.findings(raw.repartition(8, "scheme_code"), TODAY))
    assert (plan.count("Sort ["), plan.count("Exchange ")) == (1, 1)


def test_exclusion_from_a_union_works_out_findings_once(raw):
    plan = plan_of(validation.usable(raw.where("nav > 0").union(raw.where("nav is null")), validation.findings(raw, TODAY)))
    assert plan.count("Generate explode") == 1 and "SortMergeJoin" not in plan


def metric_rows(spark, values, category="C"):
    columns = peers.RANKED_METRICS
    rows = [(f"{category}{i}", f"Fund {i}", "House A" if i % 2 else "House B", category, 600, 6.0, *v) for i, v in enumerate(values)]
    kinds = ", ".join(f"{c} double" for c in columns)
    return spark.createDataFrame(rows, f"scheme_code string, scheme_name string, fund_house string, scheme_category string, observations int, history_years double, {kinds}")


def rising(n, skip=()):
    return [[None if (i, k) in skip else float(i + 1) * (-1 if c == "volatility_pct" else 1) + (10 if c == "volatility_pct" else 0)
             for k, c in enumerate(peers.RANKED_METRICS)] for i in range(n)]


def test_mid_rank_percentiles(spark):
    got = {(r.scheme_code, r.metric): r for r in peers.peer_ranks(metric_rows(spark, rising(5))).collect()}
    assert [got[f"C{i}", "sharpe_ratio"].percentile for i in range(5)] == [10, 30, 50, 70, 90]
    assert got["C4", "volatility_pct"].percentile == 90 and not got["C4", "volatility_pct"].higher_is_better
    best, worst = got["C4", "sharpe_ratio"], got["C0", "sharpe_ratio"]
    assert (best.rank, best.quartile, best.category_median) == (1, 1, 3) and (worst.rank, worst.quartile) == (5, 4)
    equal = peers.peer_ranks(metric_rows(spark, [[5.0] * 9] * 10)).collect()
    assert {r.percentile for r in equal} == {50} and {r.rank for r in equal} == {1}
    assert peers.peer_ranks(metric_rows(spark, rising(4))).count() == 0
    wide = peers.comparisons(peers.peer_ranks(metric_rows(spark, rising(5)))).where("scheme_code = 'C4'").first()
    assert wide.peers == 5 and len(wide.top_quartile) == 9 and wide.pct_sharpe_ratio == 90


def test_scores_renormalise_and_need_peers(spark):
    scored = {r.scheme_code: r for r in peers.composite_scores(metric_rows(spark, rising(8))).collect()}
    assert scored["C7"].score > scored["C0"].score and scored["C7"].score_components == 4
    no_sip = {r.scheme_code: r for r in peers.composite_scores(metric_rows(spark, rising(8, {(7, 8)}))).collect()}
    assert no_sip["C7"].score_components == 3 and no_sip["C7"].score == scored["C7"].score
    thin = peers.composite_scores(metric_rows(spark, rising(4))).collect()
    assert all(r.score is None and r.score_components == 0 for r in thin)
    parts = peers.explain_scores(peers.composite_scores(metric_rows(spark, rising(8, {(7, 8)})))).where("scheme_code = 'C7'").collect()
    assert sum(p.weight or 0 for p in parts) == pytest.approx(1) and sum(p.contribution or 0 for p in parts) == pytest.approx(no_sip["C7"].score, abs=0.06)
    assert {p.peers for p in parts} == {8}


def test_screen(spark):
    both = metric_rows(spark, rising(8)).unionByName(metric_rows(spark, [[x * 100 for x in v] for v in rising(8)], "D"))
    scored = peers.composite_scores(both)
    top = screener.screen(scored, limit=2).collect()
    assert {r.scheme_category for r in top} == {"C", "D"}  # ranked inside the category
    got = screener.screen(scored, category="C", fund_house="house a", minimums={"sharpe_ratio": 3.0}, maximums={"sharpe_ratio": 7.0}).collect()
    assert [r.scheme_code for r in got] == ["C5", "C3"]
    assert screener.bound(" sharpe_ratio = -1.5e1") == ("sharpe_ratio", -15.0)
    for bad in ("sharpe_ratio", "nothing=1", "sharpe_ratio=x"):
        with pytest.raises(ValueError):
            screener.bound(bad)
    assert "| C7 |" in screener.summarise(screener.screen(scored, category="C"))
    assert peers.category_summary(both).where("scheme_category = 'C' and metric = 'volatility_pct'").first().best == 2.0


def test_leaders_take_the_smallest_code_of_equals(spark):
    rows = [("2", 1.0, 1.0, -5.0, 3.0, None), ("10", 1.0, 2.0, -9.0, 3.0, None)]
    df = spark.createDataFrame(rows, "scheme_code string, sharpe_ratio double, cagr_3y_pct double, max_drawdown_pct double, volatility_pct double, rolling_3y_min_pct double")
    got = {r.leader: r.scheme_code for r in insights.leaders(df).collect()}
    assert got == {"best_sharpe": "2", "worst_sharpe": "2", "highest_cagr_3y": "10", "deepest_drawdown": "10", "highest_volatility": "2"}


def test_empty_columns_are_left_out(spark):
    rows = spark.createDataFrame([("a", 1.0, None, None), ("b", None, None, 2)], "k string, x double, y double, z int")
    assert screener.without_empty(rows).columns == ["k", "x", "z"]
    assert screener.without_empty(rows.where("k = 'a'")).columns == ["k", "x"] and screener.without_empty(rows.limit(0)).columns == rows.columns


@pytest.mark.parametrize("stripes", [500, 1])
def test_ranks_equal_those_of_a_window(spark, monkeypatch, stripes):
    """Of a category with ties, equal values on both sides of zero, one value a stripe and all in one."""
    monkeypatch.setattr(peers, "STRIPES", stripes)
    rng = random.Random(9)
    values = [0.0, -0.0, 1e-9, -1e-9, 5.01, 5.02, -3.3, 1e6, -1e6]
    rows = [(str(k), rng.choice(["a", "a", "a", "b", None]), rng.choice([*values, rng.gauss(0, 10), round(rng.gauss(5, 1), 2), None, float("nan")]), float(k % 5)) for k in range(400)]
    df = spark.createDataFrame(rows, "scheme_code string, scheme_category string, sharpe_ratio double, volatility_pct double")
    got = {(r.scheme_code, r.metric): r for r in peers.peer_ranks(df, ["sharpe_ratio", "volatility_pct"]).collect()}
    seen = 0
    for metric, at, sign in (("sharpe_ratio", 2, 1), ("volatility_pct", 3, -1)):
        for category in ("a", "b", None):
            peer = [(r[0], r[at]) for r in rows if r[1] == category and r[at] is not None and r[at] == r[at]]
            for code, v in peer:
                r, s = got[code, metric], [sign * x for _, x in peer]
                below, upto = sum(x < sign * v for x in s), sum(x <= sign * v for x in s)
                assert r.percentile == pytest.approx((below + upto) / 2 / len(s) * 100) and r.peers == len(s)
                assert r["rank"] == sum(x > sign * v for x in s) + 1 and r.value == v
                assert r.category_median == pytest.approx(statistics.median(x for _, x in peer), abs=1e-12)
                seen += 1
    assert seen == len(got)


def test_insights_of_many_schemes_are_bounded(spark):
    from navspark.plans.bundle import scheme_metrics

    columns = scheme_metrics(spark.createDataFrame([], "scheme_code string, date date, nav double, data_source string")).drop("notes")
    values = {
        "scheme_code": "cast(id as string)", "data_source": "if(id % 2 = 0, 'synthetic', 'amfi')", "sharpe_ratio": "id / 1e5", "cagr_3y_pct": "-id / 1e5",
        "max_drawdown_pct": "-16 - id / 1e5", "max_drawdown_recovered": "id % 4 = 0", "max_drawdown_days": "cast(id as int)", "current_drawdown_pct": "-6 - id / 1e5",
        "volatility_pct": "21 + id / 1e5", "sma_signal": "'BEARISH'", "nav_vs_sma50_pct": "-id / 1e5", "rolling_3y_min_pct": "id / 1e5",
    }
    metrics = spark.range(0, 300_000, 1, 8).selectExpr(*[f"cast({values.get(f.name, 'null')} as {f.dataType.simpleString()}) AS {f.name}" for f in columns.schema.fields])
    metrics = metrics.selectExpr("*", "concat('S', scheme_code) AS scheme_name")
    findings = spark.range(1000).selectExpr("cast(id % 400 as string) AS scheme_code", "'CRITICAL' AS severity", "'x' AS `check`")
    told = insights.derive(metrics, findings)
    assert [i.rank for i in told] == list(range(1, len(told) + 1)) and len(told) == 10
    assert all(len(i.scheme_codes) <= insights.KEPT and len(i.detail) < 4000 for i in told)
    by = {i.headline.split(" ", 1)[-1][:24]: i for i in told}
    assert told[0].n == 150_000 and told[1].n == 400 and told[0].scheme_codes[:2] == ["0", "10"]
    assert told[2].headline.startswith("S299999 earned most") and told[3].headline.startswith("S0 earned least")
    assert "not the one that earned most" in told[4].detail and told[4].scheme_codes == ["0"]
    assert "225000 scheme(s) have not made good" in told[5].detail and "and 224975 more" in told[5].detail
    assert by["scheme(s) swing by more t"[:24]].n == 300_000 and "S299999 24.0%, — on a bad day" in by["scheme(s) swing by more t"[:24]].detail
    assert not any("null" in i.detail for i in told)
