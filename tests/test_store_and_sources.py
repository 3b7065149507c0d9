"""Parsers, merges, the table store, streaming ingestion, the analysis and its reports."""

from __future__ import annotations

import datetime
import json
import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from trading_days import business_days

from navspark.functions.expr import business_gap
from navspark.commits import CommitLog, Files, Part, State
from navspark.operators import catalogue, merge, validation
from navspark.panel import clean_series, load_panel
from navspark.config import EngineConfig
from navspark.plans import bootstrap, bundle, cli, snapshot
from navspark.plans.analysis import analyse
from navspark.plans.mirror import push
from navspark.plans.refresh import load_histories, refresh_catalogue
from navspark.plans.report import write_reports
from navspark.sources import history, landing, navall, synthetic
from navspark.store import Store
from navspark.streaming.ingest import ingest
from navspark.streaming.watch import watch_landing

FEED = """Scheme Code;ISIN Div Payout/ISIN Growth;ISIN Div Reinvestment;Scheme Name;Net Asset Value;Date

Open Ended Schemes(Equity Scheme - Large Cap)

First House
100;INF1;-;First Large;10.5;02-Jan-2024
101;-;INF2;First Second;N.A.;02-January-2024

Second House
102;INF3;INF4;Second Large;20.25;2024-01-02

Open Ended Schemes(Debt Scheme)
103;INF5;-;Orphan Debt;30;02-01-2024
A notice without a separator
104;INF6;-;Noticed Debt;40;02-Jan-2024
105;too;short
100;INF1;-;Repeated;11;03-Jan-2024
"""
DAY = datetime.date(2024, 1, 2)


def test_catalogue_feed(spark, tmp_path):
    (tmp_path / "feed.txt").write_text(FEED)
    entries, skipped = navall.parse(navall.read_lines(spark, str(tmp_path / "feed.txt")))
    got = {r.scheme_code: r for r in entries.collect()}
    assert sorted(got) == ["100", "101", "102", "103", "104"] and skipped.first().skipped == 3
    assert (got["100"].fund_house, got["100"].scheme_type, got["100"].scheme_category) == ("First House", "Open Ended", "Equity Scheme - Large Cap")
    assert (got["100"].nav, got["100"].nav_date, got["100"].isin_reinvest) == (10.5, DAY, None)
    assert got["101"].nav is None and got["101"].nav_date == DAY and got["101"].isin_growth is None
    assert got["102"].fund_house == "Second House" and got["102"].nav_date == DAY
    assert got["103"].fund_house is None and got["103"].nav_date == DAY
    assert got["104"].fund_house == "A notice without a separator"


def test_history_payload(spark):
    data = {"data": [{"date": "02-01-2024", "nav": "10.5"}, {"date": "03-01-2024", "nav": "N.A."}, {"date": "2024/01/04", "nav": "1"}, {"date": "05-01-2024", "nav": "0"}]}
    df = spark.createDataFrame([("1", json.dumps(data)), ("2", "nonsense")], "scheme_code string, payload string")
    assert [(r.scheme_code, r.date, r.nav) for r in history.parse(df).collect()] == [("1", DAY, 10.5)]
    assert history.skipped(df).where("scheme_code = '1'").first().skipped == 3


def test_synthetic_is_repeatable_and_tagged(spark):
    schemes = spark.createDataFrame([("1",), ("2",)], "scheme_code string")
    a = synthetic.generate(schemes, datetime.date(2024, 1, 5), 1.0).orderBy("scheme_code", "date").collect()
    assert a == synthetic.generate(schemes, datetime.date(2024, 1, 5), 1.0).orderBy("scheme_code", "date").collect()
    assert {r.data_source for r in a} == {"synthetic"} and all(r.date.weekday() < 5 and r.nav > 0 for r in a)
    assert len({r.nav for r in a}) > 100


def navs(spark, rows):
    return spark.createDataFrame([(c, datetime.date(2024, 1, d), v, i) for i, (c, d, v) in enumerate(rows)], "scheme_code string, date date, nav double, seq int")


def test_store_upserts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.table("nav_history").count() == 0
    first = [("1", 1, 100.0), ("1", 2, 0.0), ("1", 3, -5.0), ("1", 4, 103.0)]
    got = store.upsert_nav(navs(spark, first), "amfi", "seq")
    assert (got.inserted, got.updated) == (2, 0)
    got = store.upsert_nav(navs(spark, first), "other", "seq")
    assert (got.inserted, got.updated) == (0, 0)
    got = store.upsert_nav(navs(spark, [("1", 1, 100.0), ("1", 4, 104.0), ("1", 4, 105.0), ("2", 1, 7.0)]), "restated", "seq")
    assert (got.inserted, got.updated) == (1, 1)
    rows = {(r.scheme_code, r.date.day): (r.nav, r.data_source) for r in store.table("nav_history").collect()}
    assert rows == {("1", 1): (100.0, "amfi"), ("1", 4): (105.0, "restated"), ("2", 1): (7.0, "restated")}
    info = "scheme_code string, scheme_name string, fund_house string"
    store.upsert_info(spark.createDataFrame([("1", "One", "House")], info), "amfi")
    store.upsert_info(spark.createDataFrame([("1", "One again", None), ("2", "Two", None)], info), "feed")
    rows = {r.scheme_code: (r.scheme_name, r.fund_house, r.data_source) for r in store.table("scheme_info").collect()}
    assert rows == {"1": ("One again", "House", "feed"), "2": ("Two", None, "feed")}


def test_runs_and_mirror(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.recent_runs().count() == 0
    for k, run in enumerate(("a", "b")):
        store.log_run(run, "ingest", 2 * k, status="running")
        store.log_run(run, "ingest", 2 * k + 1, status="success", rows_written=5)
    assert [(r.run_id, r.status, r.rows_written) for r in store.recent_runs().collect()] == [("b", "success", 5), ("a", "success", 5)]
    df = spark.createDataFrame([("1", datetime.date(2024, 1, 1)), ("1", datetime.date(2001, 1, 1))], "scheme_code string, date date")
    assert merge.mirror_slice(df, datetime.date(2024, 2, 1)).count() == 1


def test_stream_restates_and_resumes(spark, tmp_path):
    store, landing = Store(spark, str(tmp_path / "s")), tmp_path / "in"
    landing.mkdir()

    def land(name, nav):
        data = json.dumps({"data": [{"date": "02-01-2024", "nav": nav}]})
        (landing / name).write_text(json.dumps({"scheme_code": "1", "payload": data}) + "\n")

    for name, nav in (("a.json", "10"), ("b.json", "11")):
        land(name, nav)
        query = ingest(store, str(landing), str(tmp_path / "cp"))
        query.awaitTermination(120)
    assert [(r.nav, r.data_source) for r in store.table("nav_history").collect()] == [(11.0, "amfi")]


def test_the_later_file_of_a_batch_wins(spark, tmp_path):
    """In one micro-batch and in one batch read, whatever the places inside the payloads."""
    days = [{"date": "01-01-2024", "nav": "1"}, {"date": "02-01-2024", "nav": "10"}]
    for k, (name, data) in enumerate([("z.json", days), ("a.json", [{"date": "02-01-2024", "nav": "11"}])]):
        path = tmp_path / "in" / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(json.dumps({"scheme_code": "1", "payload": json.dumps({"data": data})}) + "\n")
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    store = Store(spark, str(tmp_path / "s"))
    ingest(store, str(tmp_path / "in"), str(tmp_path / "cp")).awaitTermination(120)
    assert {r.date.day: r.nav for r in store.table("nav_history").collect()} == {1: 1.0, 2: 11.0}
    other = Store(spark, str(tmp_path / "o"))
    got = load_histories(other, ["1", "2"], str(tmp_path / "in"), DAY, allow_synthetic=True)
    assert (got.loaded, got.generated, got.failed) == (["1"], ["2"], [])
    assert {r.date.day: r.nav for r in other.table("nav_history").where("scheme_code = '1'").collect()} == {1: 1.0, 2: 11.0}
    forced = load_histories(other, ["1", "3"], None, DAY, synthetic_only=True)
    assert (forced.generated, forced.failed) == (["3"], ["1"])  # never over published NAVs
    assert not load_histories(other, ["4"], None, DAY).ok


def test_an_upsert_rewrites_the_partitions_it_touches(spark, tmp_path):
    store = Store(spark, str(tmp_path), splits=2)
    months = [(str(c), datetime.date(2024, m, 1), 1.0, 0) for c in range(12) for m in (1, 2)]
    kind = "scheme_code string, date date, nav double, seq int"
    store.upsert_nav(spark.createDataFrame(months, kind), "amfi", "seq")
    before = store.current("nav_history")
    # a day's feed of all schemes: no other month is written
    feed = [(str(c), datetime.date(2024, 2, 2), 2.0 if c < 6 else 0.0, 0) for c in range(12)]
    assert store.upsert_nav(spark.createDataFrame(feed, kind), "amfi", "seq").inserted == 6
    after = store.current("nav_history")
    assert {k for k in before if before[k] != after[k]} <= {k for k in before if k[1] == 202402}
    assert len({k[0] for k in before}) > 5 and all(before[k] == after[k] for k in before if k[1] == 202401)
    assert store.table("nav_history").count() == 30 and store.table("nav_history").where("updated_at is null").count() == 0
    old = store.table("nav_history").where("scheme_code = '8'").first().updated_at
    for nav in (3.0, 3.0, 4.0):
        store.upsert_nav(spark.createDataFrame([("7", datetime.date(2024, 2, 3), nav, 0)], kind), "amfi", "seq")
    assert store.table("nav_history").where("scheme_code = '8'").first().updated_at == old
    # what a feed leaves alone leaves no folder behind, and what is replaced goes with its version
    folders = lambda: len(list((tmp_path / "nav_history").glob("*/bucket=*/month=*")))
    current = len(store.current("nav_history"))
    assert folders() > current
    store.expire("nav_history", keep=1)
    assert folders() == current and store.expire("nav_history", keep=1) == 0
    assert store.table("nav_history").count() == 31
    # a folder that a failed writer left goes when it is old
    (tmp_path / "nav_history/dead/bucket=1/month=202401").mkdir(parents=True)
    assert store.expire("nav_history") == 0 and store.expire("nav_history", grace=-60) == 1 and not (tmp_path / "nav_history/dead").exists()
    assert not list((tmp_path / "_staging").glob("*"))


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    bad = navs(spark, [("1", 1, 1.0)]).withColumn("nav", F.expr("if(nav = 1.0, double(raise_error('no')), nav)"))
    with pytest.raises(Exception, match="no"):
        store.upsert_nav(bad, "amfi", "seq")
    assert store.current("nav_history") == {} and not list((tmp_path / "_staging").glob("*"))


def test_a_scan_opens_only_what_it_may_need(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = [(str(c), datetime.date(2024, m, 1), 1.0, 0) for c in range(60) for m in (1, 2, 3)]
    store.upsert_nav(spark.createDataFrame(rows, "scheme_code string, date date, nav double, seq int"), "amfi", "seq")
    opened = lambda df: {f.split("/bucket=")[1].rsplit("/", 1)[0] for f in df.inputFiles()}
    assert len(opened(store.table("nav_history"))) > 40
    some = store.table("nav_history", ["3", "4", "50"])
    assert len({x.split("/")[0] for x in opened(some)}) <= 3 and some.count() == 9
    late = store.table("nav_history", ["3"], since=datetime.date(2024, 2, 1))
    assert len(opened(late)) == 2 and late.count() == 2
    assert store.table("nav_history", until=datetime.date(2024, 1, 31)).count() == 60
    assert store.table("nav_history", []).count() == 180
    assert len(opened(analyse(store.table("nav_history", ["3", "4"]), store.table("scheme_info"), DAY, ["3", "4"]).coverage)) <= 6


def test_two_writers_lose_nothing(spark, tmp_path):
    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    store.upsert_nav(navs(spark, [("1", 1, 1.0)]), "amfi", "seq")
    taken = []

    def meanwhile(write):
        """The other writer commits between this one's reading and its commit, once."""
        real = Store._write

        def slow(self, *a):
            out = real(self, *a)
            if self is store and not taken:
                taken.append(1)
                write()
            return out

        return slow

    for rows in ([("1", 2, 5.0)], [("2", 1, 7.0)]):  # in the same partition, and in another
        taken.clear()
        with pytest.MonkeyPatch.context() as m:
            m.setattr(Store, "_write", meanwhile(lambda rows=rows: other.upsert_nav(navs(spark, rows), "other", "seq")))
            assert store.upsert_nav(navs(spark, [("1", 3 if rows[0][0] == "1" else 4, 9.0)]), "amfi", "seq").inserted == 1
        assert taken
    rows = {(r.scheme_code, r.date.day): r.nav for r in store.table("nav_history").collect()}
    assert rows == {("1", 1): 1.0, ("1", 2): 5.0, ("1", 3): 9.0, ("2", 1): 7.0, ("1", 4): 9.0}
    with ThreadPoolExecutor(3) as pool:
        done = [pool.submit(Store(spark, str(tmp_path)).upsert_nav, navs(spark, [("1", 10 + k, 1.0), ("2", 10 + k, 2.0)]), "amfi", "seq") for k in range(6)]
        assert [d.result().inserted for d in done] == [2] * 6
    assert store.table("nav_history").count() == 17
    assert len(store.log("nav_history").versions()) == 11


def test_log_snapshots_and_earlier_versions(spark, tmp_path):
    log = CommitLog(Files(spark), str(tmp_path))
    for v in range(1, 36):
        assert log.commit(log.state(), [Part(v % 3, 0, f"p{v}", v)])
        assert not log.commit(State(v - 1, {}), [Part(9, 0, "late", 1)])  # that version is taken
    assert log.state().version == 35 and {p.path for p in log.state().parts.values()} == {"p33", "p34", "p35"}
    assert {p.path for p in log.state(20).parts.values()} == {"p18", "p19", "p20"}
    log.trim(2)
    assert log.versions()[0] == 32 and {p.path for p in log.state().parts.values()} == {"p33", "p34", "p35"}


def test_repeated_codes_are_one_scheme(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    batch = spark.createDataFrame([("1", "B", 2), ("1", "A", 3), ("2", "C", 1), (None, "D", 1)], "scheme_code string, scheme_name string, n int")
    assert store.upsert_info(batch, "feed", "n") == 2 and store.upsert_info(batch.drop("n"), "feed") == 2
    assert sorted((r.scheme_code, r.scheme_name) for r in store.table("scheme_info").collect()) == [("1", "B"), ("2", "C")]


def test_nan_is_no_price(spark, tmp_path):
    store, nan = Store(spark, str(tmp_path)), float("nan")
    rows = navs(spark, [("1", 1, nan), ("1", 2, 5.0), ("1", 2, nan)])
    assert store.upsert_nav(rows, "amfi", "seq").inserted == 1
    assert [r.nav for r in clean_series(rows, "seq").collect()] == [5.0]
    found = validation.findings(rows.selectExpr("*", "'n' AS scheme_name", "'amfi' AS data_source"), DAY)
    assert found.where("check = 'non_positive_nav'").first().affected_rows == 2


def test_runs_are_closed_and_newest_first(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for k in range(5):
        with store.run(f"kind{k}") as end:
            end["rows_written"] = k
    with pytest.raises(ZeroDivisionError), store.run("broken", schemes=",".join(map(str, range(200)))):
        1 / 0  # noqa: B018
    got = store.recent_runs(3).collect()
    assert [(r.kind, r.status) for r in got] == [("broken", "failed"), ("kind4", "success"), ("kind3", "success")]
    assert got[0].message.startswith("ZeroDivisionError") and got[0].schemes.endswith(",199")
    assert store.merge_events() == 12 and store.merge_events() == 0
    assert [r.kind for r in store.recent_runs(3).collect()] == ["broken", "kind4", "kind3"]
    assert len(list((tmp_path / "ingestion_runs").glob("*.json"))) == 1


def test_metric_snapshot_follows_the_buckets(spark, tmp_path):
    store, days = Store(spark, str(tmp_path)), business_days("2023-01-02", 60)
    assert snapshot.metrics(store).count() == 0
    rows = [(str(c), d, 100.0 + c + i % 7, 0) for c in range(8) for i, d in enumerate(days)]
    kind = "scheme_code string, date date, nav double, seq int"
    store.upsert_nav(spark.createDataFrame(rows, kind), "amfi", "seq")
    whole = lambda: bundle.scheme_metrics(clean_series(store.table("nav_history"), "updated_at", "nav"))
    read = lambda df: sorted(str(r.asDict()) for r in df.select(sorted(df.columns)).collect())
    assert read(snapshot.metrics(store)) == read(whole())
    before = store.current(snapshot.NAME)
    assert len(before) > 3 and snapshot.refresh(store) == 0
    store.upsert_nav(spark.createDataFrame([("3", days[-1] + datetime.timedelta(3), 200.0, 0)], kind), "amfi", "seq")
    assert snapshot.refresh(store) == 1
    after = store.current(snapshot.NAME)
    assert sum(before[k] != after[k] for k in before) == 1
    assert read(snapshot.metrics(store)) == read(whole())
    assert snapshot.refresh(store, EngineConfig(risk_free=0.01)) == len(before)
    assert store.expire(snapshot.NAME, keep=1) == len(before) + 1


def test_mirror_push_resumes(spark, tmp_path):
    source = Store(spark, str(tmp_path / "source"))
    rows = [(str(c), datetime.date(y, m, 5), float(c + m), 0) for c in range(4) for y in (2015, 2024) for m in (1, 2, 3)]
    kind = "scheme_code string, date date, nav double, seq int"
    source.upsert_nav(spark.createDataFrame(rows, kind), "amfi", "seq")
    source.upsert_info(spark.createDataFrame([(str(c), f"N{c}") for c in range(4)], "scheme_code string, scheme_name string"), "feed")
    today = datetime.date(2024, 4, 1)
    held = lambda s: sorted(tuple(r) for r in s.table("nav_history").select("scheme_code", "date", "nav", "data_source").collect())
    clean, broken = Store(spark, str(tmp_path / "clean")), Store(spark, str(tmp_path / "broken"))
    for mirror in (clean, broken):  # rows that the mirror has of its own
        mirror.upsert_nav(spark.createDataFrame([("0", datetime.date(2024, 1, 5), 99.0, 0), ("9", datetime.date(2010, 1, 1), 9.0, 0)], kind), "mirror", "seq")
    done = push(source, clean, today, batch_rows=2)
    assert (done.schemes, done.rows, done.skipped) == (4, 12, 0) and done.batches >= 6
    real, calls = Store.take, []

    def dies(self, parts, rows):
        calls.append(parts)
        if len(calls) == 3:
            raise OSError("the line is down")
        return real(self, parts, rows)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(Store, "take", dies)
        with pytest.raises(OSError):
            push(source, broken, today, batch_rows=2)
    assert [r.status for r in broken.recent_runs(4).orderBy("started_at").collect()] == ["failed", "success", "success", "failed"]
    again = push(source, broken, today, batch_rows=2)
    assert again.skipped == sum(map(len, calls[:2])) and again.batches == done.batches - 2
    assert held(broken) == held(clean) and len(held(clean)) == 13
    assert push(source, clean, today).batches == 0
    source.upsert_nav(spark.createDataFrame([("2", datetime.date(2024, 3, 6), 5.0, 0)], kind), "amfi", "seq")
    assert push(source, clean, today).batches == 1 and len(held(clean)) == 14
    names = {r.scheme_name for r in clean.table("scheme_info").collect()}
    assert names == {"N0", "N1", "N2", "N3"}


@pytest.mark.parametrize("seed", [1, 2])
def test_the_stream_finds_what_the_gate_finds(spark, tmp_path, seed):
    """Of files in any split and order, with late and restated days."""
    rng, days = random.Random(seed), business_days("2024-01-01", 60)
    rows = []
    for code in ("1", "2", "3"):
        some = sorted(rng.sample(days, 30)) if code != "3" else days[:1]
        rows += [(code, d, round(rng.choice([10, 10, 10, 14]) + rng.random(), 2)) for d in some]
    restated = [(c, d, v * 2) for c, d, v in rng.sample(rows, 5)]
    rng.shuffle(rows)
    landed = {}
    for k, part in enumerate([rows[:20], rows[20:45], rows[45:], restated]):
        for code in {r[0] for r in part}:
            data = [{"date": d.strftime("%d-%m-%Y"), "nav": str(v)} for c, d, v in part if c == code]
            path = tmp_path / f"in/{k}-{code}.json"
            path.parent.mkdir(exist_ok=True)
            path.write_text(json.dumps({"scheme_code": code, "payload": json.dumps({"data": data})}) + "\n")
            os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
        landed |= {(c, d): v for c, d, v in part}
    seen = {}

    def keep(batch, _):
        seen.update({r.scheme_code: r for r in batch.collect()})

    for stop in (True, False):  # resumes from its checkpoint
        query = watch_landing(spark, str(tmp_path / "in"), 2).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
        query.trigger(availableNow=True).start().awaitTermination(200)
        if stop:
            extra = [("2", days[-1] + datetime.timedelta(40), 11.0)]
            data = [{"date": d.strftime("%d-%m-%Y"), "nav": str(v)} for _, d, v in extra]
            (tmp_path / "in/z.json").write_text(json.dumps({"scheme_code": "2", "payload": json.dumps({"data": data})}) + "\n")
            landed |= {(c, d): v for c, d, v in extra}
    raw = spark.createDataFrame([(c, d, float(v), "n", "amfi") for (c, d), v in landed.items()], "scheme_code string, date date, nav double, scheme_name string, data_source string")
    for r in validation.ingredients(raw, days[-1]).collect():
        got = seen[r.scheme_code]
        same = ["observations", "first_date", "last_date", "extreme", "gaps", "largest_gap"]
        assert [got[c] for c in same] == [r[c] for c in same], r.scheme_code
        assert got.worst_move == pytest.approx(r.worst_move) if r.worst_move is not None else got.worst_move is None
        assert r.worst_move is None or got.worst_date == r.worst_date
    assert seen["1"].late > 0 and seen["3"].observations == 1 and sum(r.gaps for r in seen.values()) > 0


def test_catalogue_queries(spark):
    info = spark.createDataFrame(
        [("1", "Alpha Fund", "H1", "Eq", "Open Ended Schemes"), ("2", "Beta alpha", "H2", "Eq", "Interval Fund"), ("3", "Gamma", None, "Debt", "Close")],
        "scheme_code string, scheme_name string, fund_house string, scheme_category string, scheme_type string",
    )
    days = business_days("2024-01-01", 40)
    nav = spark.createDataFrame([("1", d, 1.0, "amfi") for d in days] + [("2", d, 1.0, "amfi") for d in days[:5]] + [("9", days[0], 2.0, "amfi")],
                                "scheme_code string, date date, nav double, data_source string")
    assert [r.scheme_code for r in catalogue.search(info, nav, query="ALPHA").collect()] == ["1", "2"]
    assert [r.scheme_code for r in catalogue.search(info, nav, query="alpha", with_history_only=True).collect()] == ["1"]
    one = catalogue.statistics(info, nav).first()
    assert (one.schemes, one.categories, one.fund_houses, one.analysable, one.nav_rows) == (3, 2, 2, 1, 46)
    assert [r.scheme_code for r in catalogue.backfill_queue(info, nav).collect()] == ["2", "3"]
    assert [r.observations for r in catalogue.scheme_coverage(info, nav).collect()] == [0, 40, 5]
    assert [r.scheme_category for r in catalogue.categories(info).collect()] == ["Debt", "Eq"]
    panel = load_panel(nav, info)
    assert panel.where("scheme_code = '9'").first().scheme_name == "Unknown scheme 9"
    assert load_panel(nav, info, []).count() == panel.count()


def test_business_gap(spark):
    pairs = [("2024-01-05", "2024-01-08", 0), ("2024-01-01", "2024-01-02", 0), ("2024-01-01", "2024-01-10", 6), ("2024-01-06", "2024-01-08", -1)]
    df = spark.createDataFrame([(datetime.date.fromisoformat(a), datetime.date.fromisoformat(b), n) for a, b, n in pairs], "a date, b date, n int")
    assert all(r.got == r.n for r in df.withColumn("got", business_gap(F.col("a"), F.col("b"))).collect())


def test_analysis_and_reports(spark, tmp_path):
    days = business_days("2020-01-01", 900)
    rows = [(c, d, 100 * (1 + k / 20) ** (i / 250) * (1 + 0.02 * ((i * 7 + k) % 5)), "amfi") for k, c in enumerate("abc") for i, d in enumerate(days)]
    rows += [("bad", d, 1.0, "amfi") for d in days[:5]]
    nav = spark.createDataFrame(rows, "scheme_code string, date date, nav double, data_source string")
    info = spark.createDataFrame([(c, f"Fund {c}", "H", "Eq") for c in "abc"], "scheme_code string, scheme_name string, fund_house string, scheme_category string")
    result = analyse(nav, info, days[-1], ["a", "b", "bad", "gone"], "c")
    assert [r.scheme_code for r in result.rows()] == ["a", "b"]
    assert {r.scheme_code for r in result.findings.where("severity = 'CRITICAL'").collect()} == {"bad", "gone"}
    told = result.insights()
    assert told[0].category == "data-integrity" and told[0].scheme_codes == ["bad", "gone"]
    assert [i.rank for i in told] == list(range(1, len(told) + 1)) and any(i.category == "benchmark" for i in told)
    assert result.ranked_by("sharpe_ratio").count() == 2
    files = write_reports(result, nav, str(tmp_path))
    assert files == ["report.md", "index.html", "report.json", "fund_metrics.csv"]
    assert len(json.loads((tmp_path / "report.json").read_text())["schemes"]) == 2
    assert "<svg" in (tmp_path / "index.html").read_text()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "feed.txt").write_text(FEED)
    (tmp_path / "none.txt").write_text("nothing\n")
    root, summary = str(tmp_path / "t"), tmp_path / "summary.md"
    told = ["--out", str(tmp_path / "r"), "--today", "2024-01-05", "--summary-file", str(summary)]
    assert cli.main([]) == cli.main(["screen"]) == cli.main(["--root", root, "--schemes"]) == 1
    assert cli.main(["catalogue", "--root", root, "--feed", str(tmp_path / "none.txt")]) == 2
    assert cli.main(["catalogue", "--root", root, "--feed", str(tmp_path / "feed.txt"), "--no-navs", "--summary-file", str(summary)]) == 0
    assert "5 schemes in 2 categories" in capsys.readouterr().out and "nav_rows 0" in summary.read_text()
    # nothing stored: a filter finds nothing, the default schemes stand in for all analysable ones
    assert cli.main(["--root", root, "--category", "Debt Scheme", *told]) == 1
    assert cli.main(["--root", root, "--all-analysable", "--default-schemes", "100", "101", "--allow-synthetic", *told]) == 0
    assert "WARNING" in capsys.readouterr().err and (tmp_path / "r/report.md").exists()
    gone = ["--landing", str(tmp_path / "in")]
    assert cli.main(["--root", root, "--schemes", "9", *gone, *told]) == 2 and "nothing at" in capsys.readouterr().err
    assert cli.main(["catalogue", "--root", root, "--feed", str(tmp_path / "gone.txt")]) == 2
    assert Store(spark, root).recent_runs(1).first().status == "failed"
    assert cli.main(["--root", root, "--schemes", "9", *gone, "--allow-synthetic", "--summary-file", str(tmp_path / "no/such"), *told[:4]]) == 0
    assert "series are generated" in capsys.readouterr().err
    assert cli.main(["--root", root, "--schemes", "100", "gone", "--skip-fetch", "--fail-on-critical", *told]) == 3
    assert cli.main(["--root", root, "--schemes", "100", "gone", "--skip-fetch", *told]) == 0
    assert cli.main(["--root", root, "--schemes", "gone", "--skip-fetch", *told]) == 1
    screen = ["screen", "--root", root]
    assert cli.main([*screen, "--min", "observations=100", "--max", "max_drawdown_pct=0", "--sort-by", "volatility_pct", "--ascending", "--csv", str(tmp_path / "csv")]) == 0
    assert "First Large" in capsys.readouterr().out and spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert cli.main([*screen, "--min", "sharpe_ratio=1000"]) == 1 and cli.main([*screen, "--min", "nonsense=1"]) == 1
    assert cli.main([*screen, "--explain", "100"]) == 0 and cli.main([*screen, "--explain", "x"]) == 1
    data = json.dumps({"data": [{"date": "02-01-2024", "nav": "10"}]})
    backfill = ["catalogue", "--root", root, "--backfill", "5", "--backfill-category", "Equity Scheme - Large Cap"]
    assert cli.main([*backfill, "--fetcher", "math:no"]) == 1
    assert cli.main([*backfill, "--fetcher", "builtins:len", "--landing", str(tmp_path / "fetched"), "--delay", "0", "--time-budget", "-1"]) == 2
    assert "left for want of time" in capsys.readouterr().err
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"scheme_code": "103", "payload": data}) + "\n")
    assert cli.main(["catalogue", "--root", root, "--backfill", "5", "--backfill-category", "Debt Scheme", "--landing", str(tmp_path / "in")]) == 0
    assert "history of 1 schemes loaded, 1 not landed" in capsys.readouterr().out


@pytest.mark.parametrize("name", ["scheme_metrics_full", "screen", "dq_findings", "nav_upsert_merge"])
def test_queries_run_on_driver_tables(spark, name):
    from navspark import queries

    assert queries.queries()[name](spark, "/root/testdata/sf0.001").count() >= 0


def test_mirror_push_sorts_spread_sides_once(spark):
    from navspark import queries

    plan = queries.queries()["mirror_push"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Sort ["), plan.count("Exchange ")) == (1, 2)


def test_prices_are_spread_over_enough_tasks(spark, monkeypatch):
    from navspark import panel

    monkeypatch.setattr(panel, "TASK_ROWS", 1000, raising=False)
    folder = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert panel.star_nav(spark, folder).rdd.getNumPartitions() == -(-lines // 1000) > 4


def test_asking_retries_and_stops_in_time():
    assert list(landing.waits(3, 2.0, lambda: 1.0)) == [0.0, 2.0, 4.0] and list(landing.waits(0, 2.0)) == [0.0]
    slept, calls = [], {"flaky": 0}

    def fetch(code):
        if code == "flaky":
            calls[code] += 1
        if code == "bad" or calls["flaky"] in (1, 2):
            raise OSError("gone")
        return {"data": []}

    ask = lambda codes, *a, **k: list(landing.asked(fetch, codes, landing.Manners(*a), sleep=slept.append, **k))
    got = ask(["flaky"], 3, 2.0)
    assert got == [("flaky", '{"data": []}', "landed", None, 3)] and len(slept) == 2 and 1 <= slept[0] <= 3 and 2 <= slept[1] <= 6
    slept.clear()
    got = ask(["1", "bad", "2"], 1, 2.0, 0.5)
    assert [r[2] for r in got] == ["landed", "failed", "landed"] and "gave up after 1 tries: gone" in got[1][3] and slept == [0.5, 0.5]
    ticks = iter(range(10))
    got = ask(["1", "2", "3"], 1, 2.0, 0.0, 1.0, clock=lambda: next(ticks))
    assert [r[2] for r in got] == ["landed", "left", "left"]
    assert landing.silence("127.0.0.1", 1, 0.2)


def test_a_backfill_that_dies_goes_on(spark, tmp_path):
    """Every history is fetched once, by tasks; what a task landed stays when the job dies."""
    asked, codes = tmp_path / "asked", [str(c) for c in range(20)]
    asked.mkdir()

    def fetcher(kills):
        def fetch(code):
            if code in kills:
                raise SystemExit("the executor is gone")
            if code == "7":
                raise OSError("no such scheme")
            with (asked / code).open("a") as f:
                f.write("x")
            return {"data": [{"date": "02-01-2024", "nav": str(10 + int(code))}]}

        return fetch

    land = lambda kills, **k: landing.land_histories(spark, fetcher(kills), codes, str(tmp_path / "in"), "monday", lanes=2, group=2, delay=0, tries=1, **k)
    with pytest.raises(Exception, match="gone"):
        land({"12"})
    first = {p.name for p in asked.iterdir()}
    assert len(first) >= 9
    got = land(set())
    assert (len(got.landed), list(got.failed), got.left, got.status) == (19, ["7"], [], "partial")
    assert all((asked / c).read_text() == "x" for c in first - {"13", "14", "15"})  # other tasks of the wave may have died unfinished
    assert len(land(set()).landed) == 19 and (asked / "0").read_text() == "x"
    store = Store(spark, str(tmp_path / "s"))
    assert load_histories(store, codes, str(tmp_path / "in"), DAY).failed == ["7"]
    assert {r.nav for r in store.table("nav_history").collect()} == {10.0 + c for c in range(20) if c != 7}
    assert landing.land_histories(spark, fetcher(set()), ["1", "2"], str(tmp_path / "in"), "tuesday", budget_seconds=-1).left == ["1", "2"]


def test_bootstrap(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert bootstrap.ensure(store, lambda s: None, enabled=False).status == "skipped"
    assert bootstrap.ensure(store, lambda s: None).status == "failed"
    assert bootstrap.ensure(store, lambda s: 1 / 0).message == "division by zero"
    load = lambda s: s.upsert_nav(navs(spark, [("1", 1, 10.0)]), "amfi", "seq")
    assert bootstrap.ensure(store, load) == bootstrap.BootstrapResult("loaded", "", 1)
    assert bootstrap.ensure(store, lambda s: 1 / 0).ok
    broken = Store(spark, str(tmp_path / "broken"))
    (tmp_path / "broken/_log/nav_history").mkdir(parents=True)
    (tmp_path / "broken/_log/nav_history/v00000000000000000001.json").write_text("not a table")
    assert bootstrap.ensure(broken, lambda s: None).status == "failed"


def test_catalogue_refresh_result(spark, tmp_path):
    (tmp_path / "feed.txt").write_text(FEED)
    (tmp_path / "none.txt").write_text("a notice\n")
    store = Store(spark, str(tmp_path / "s"))
    got = refresh_catalogue(store, str(tmp_path / "feed.txt"))
    assert (got.parsed, got.categories, got.fund_houses, got.newest, got.changed) == (5, 2, 3, DAY, 5)
    assert (got.navs.inserted, got.error) == (4, "")
    assert refresh_catalogue(store, str(tmp_path / "none.txt")).error and store.table("scheme_info").count() == 5
