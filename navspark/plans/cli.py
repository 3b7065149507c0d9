"""Command line.

    python -m navspark.plans.cli [analyse] --root TABLES ...     load, check, measure, report
    python -m navspark.plans.cli screen --root TABLES ...        score and filter stored schemes
    python -m navspark.plans.cli catalogue --root TABLES ...     load a catalogue feed and landed histories

Exit codes: 0 done; 1 bad arguments, nothing to analyse or nothing measured; 2 loading failed; 3 a critical finding of
the quality gate, with --fail-on-critical.
"""

from __future__ import annotations

import argparse
import datetime
import importlib
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import catalogue, peers, screener, validation
from ..sources import landing
from ..store import Store
from . import bundle, snapshot
from .analysis import analyse
from .refresh import load_histories, refresh_catalogue
from .report import console, markdown, write_reports
from .snapshot import settled

DONE, NOTHING, NOT_LOADED, CRITICAL = range(4)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="navspark")
    kinds = p.add_subparsers(dest="command", required=True)
    a = kinds.add_parser("analyse", help="load, check, measure and report")
    s = kinds.add_parser("screen", help="score and filter stored schemes")
    c = kinds.add_parser("catalogue", help="load a catalogue feed and landed histories")
    for k in (a, s, c):
        k.add_argument("--root", required=True, help="folder of the tables")
        k.add_argument("--summary-file", type=Path, help="append the result as Markdown to this file")
    for k in (a, s):
        k.add_argument("--category")
        k.add_argument("--fund-house")
    for k in (a, c):
        k.add_argument("--feed", help="catalogue feed file to load first")
        k.add_argument("--landing", help="folder of JSON-line history payloads to load")
        k.add_argument("--today", type=datetime.date.fromisoformat, default=datetime.date.today())
    a.add_argument("--schemes", nargs="+", default=[], metavar="CODE")
    a.add_argument("--default-schemes", nargs="+", default=list(EngineConfig().universe), metavar="CODE")
    a.add_argument("--all-analysable", action="store_true", help="every stored scheme with enough NAVs; loads nothing")
    a.add_argument("--limit", type=int, default=100, help="most schemes taken from the tables")
    a.add_argument("--benchmark", default="none", help="a scheme code, or none")
    a.add_argument("--risk-free", type=float, default=EngineConfig().risk_free)
    a.add_argument("--sip-amount", type=float, default=EngineConfig().sip_amount)
    a.add_argument("--skip-fetch", action="store_true", help="load nothing")
    a.add_argument("--allow-synthetic", action="store_true", help="generate NAVs for schemes whose history does not come")
    a.add_argument("--synthetic-only", action="store_true", help="generate NAVs instead of loading any")
    a.add_argument("--fail-on-critical", action="store_true")
    a.add_argument("--out", default="reports")
    s.add_argument("--query", help="pattern in the scheme's name")
    s.add_argument("--min", dest="minimums", type=screener.bound, action="append", default=[], metavar="METRIC=NUMBER")
    s.add_argument("--max", dest="maximums", type=screener.bound, action="append", default=[], metavar="METRIC=NUMBER")
    s.add_argument("--sort-by", default="score")
    s.add_argument("--ascending", action="store_true")
    s.add_argument("--limit", type=int, default=25)
    s.add_argument("--explain", metavar="CODE", help="the parts of this scheme's score instead of a screen")
    s.add_argument("--csv", help="folder for the whole screen as CSV")
    c.add_argument("--no-navs", action="store_true", help="leave the feed's NAVs out")
    c.add_argument("--backfill", type=int, default=0, metavar="N", help="load landed histories of the next N schemes in the queue")
    c.add_argument("--fetcher", metavar="MODULE:FUNCTION", help="fetches a scheme's history; without one, landed payloads are loaded")
    c.add_argument("--time-budget", type=float, metavar="SECONDS", help="begin no fetch after so long")
    c.add_argument("--delay", type=float, default=1.0, metavar="SECONDS", help="wait between a lane's fetches")
    c.add_argument("--lanes", type=int, default=4, help="fetches at a time")
    c.add_argument("--run", help="name of the backfill; one that died goes on under its name (default: the day)")
    c.add_argument("--backfill-category")
    c.add_argument("--backfill-fund-house")
    return p


def universe(store: Store, args: argparse.Namespace) -> tuple[list[str], bool]:
    """The codes to analyse and whether to load first: named ones, else those that the tables' filters find, else the
    default ones.  Filters that find nothing give nothing; without a filter the default ones stand in, loudly."""
    if args.schemes:
        return args.schemes, not args.skip_fetch
    narrow = args.category or args.fund_house
    if not (narrow or args.all_analysable):
        return args.default_schemes, not args.skip_fetch
    found = catalogue.search(
        store.table("scheme_info"), store.table("nav_history"), category=args.category, fund_house=args.fund_house,
        with_history_only=True, limit=max(1, args.limit),
    )
    codes = [r.scheme_code for r in found.select("scheme_code").collect()]
    if codes or narrow:
        return codes, False
    print(f"WARNING: no stored scheme has enough NAVs; analysing the {len(args.default_schemes)} default ones instead", file=sys.stderr)
    return args.default_schemes, not args.skip_fetch


def appended(path: Path | None, text: str) -> None:
    """A summary that cannot be written is told and changes no result."""
    if path:
        try:
            with path.open("a") as f:
                f.write(text.rstrip() + "\n")
        except OSError as e:
            print(f"WARNING: no summary: {e}", file=sys.stderr)


def run_analyse(store: Store, args: argparse.Namespace) -> int:
    if args.feed and not args.skip_fetch and (error := refresh_catalogue(store, args.feed).error):
        print(error, file=sys.stderr)
        return NOT_LOADED
    codes, load = universe(store, args)
    if not codes:
        print("no scheme to analyse", file=sys.stderr)
        return NOTHING
    benchmark = None if args.benchmark in ("none", "") else args.benchmark
    if load and (args.landing or args.allow_synthetic or args.synthetic_only):
        wanted = [*codes, *([benchmark] if benchmark and benchmark not in codes else [])]
        done = load_histories(store, wanted, args.landing, args.today, args.allow_synthetic, args.synthetic_only)
        if not done.ok:
            print(f"no history was loaded{': ' * bool(done.error)}{done.error}; generate one with --allow-synthetic, or use what is stored with --skip-fetch", file=sys.stderr)
            return NOT_LOADED
        if done.error:
            print(f"WARNING: {done.error}; {len(done.generated)} series are generated", file=sys.stderr)
    nav = store.table("nav_history", [*codes, *([benchmark] if benchmark else [])])
    info = store.table("scheme_info")
    config = EngineConfig(risk_free=args.risk_free, sip_amount=args.sip_amount)
    result = analyse(nav, info, args.today, codes, benchmark, config)
    rows, findings = result.rows(), validation.sorted_findings(result.findings).collect()
    write_reports(result, nav, args.out)
    print(console(rows))
    if args.summary_file:
        appended(args.summary_file, markdown(rows, findings, result.insights(), vars(config)))
    critical = [f for f in findings if f.severity == "CRITICAL"]
    for f in critical:
        print(f"CRITICAL {f.scheme_code}: {f.message}", file=sys.stderr)
    if args.fail_on_critical and (critical or not rows):
        return CRITICAL
    return DONE if rows else NOTHING


def run_screen(store: Store, args: argparse.Namespace) -> int:
    info = store.table("scheme_info").select("scheme_code", "scheme_name", "fund_house", "scheme_category")
    metrics = settled(bundle.rounded(snapshot.metrics(store)).join(info, "scheme_code"))
    scored = peers.composite_scores(metrics)
    if args.explain:
        parts = peers.explain_scores(scored).where(F.col("scheme_code") == args.explain)
        rows = parts.collect()
        for r in rows:
            print("  ".join("—" if v is None else str(v) for v in r))
        return DONE if rows else NOTHING
    whole = screener.screen(
        scored, args.category, args.fund_house, args.query, dict(args.minimums), dict(args.maximums), args.sort_by, None, args.ascending
    ).persist()
    if args.csv:
        plain = [f.name for f in whole.schema.fields if f.dataType.typeName() not in ("array", "struct", "map")]
        whole.select(*plain).write.mode("overwrite").option("header", True).csv(args.csv)
    text = screener.summarise(whole.limit(args.limit), args.limit)
    print(text)
    appended(args.summary_file, text)
    empty = whole.isEmpty()
    whole.unpersist()
    return NOTHING if empty else DONE


def fetched(store: Store, args: argparse.Namespace, codes: list[str]) -> landing.LandingResult:
    """The schemes' histories, fetched into the landing folder as an audited run."""
    module, name = args.fetcher.split(":")
    with store.run("backfill", schemes=",".join(codes)) as end:
        got = landing.land_histories(
            store.spark, getattr(importlib.import_module(module), name), codes, args.landing, args.run or args.today.isoformat(),
            args.time_budget, args.lanes, delay=args.delay,
        )
        end |= {"status": got.status, "message": "; ".join(f"{k}: {v}" for k, v in got.failed.items())}
    return got


def run_catalogue(store: Store, args: argparse.Namespace) -> int:
    lines = []
    if args.feed:
        got = refresh_catalogue(store, args.feed, not args.no_navs)
        if got.error:
            print(got.error, file=sys.stderr)
            return NOT_LOADED
        lines.append(f"{got.parsed} schemes in {got.categories} categories of {got.fund_houses} houses; newest NAV {got.newest}; {got.navs.inserted} NAVs added, {got.navs.updated} changed")
    if args.fetcher and not (args.landing and ":" in args.fetcher):
        print("--fetcher is MODULE:FUNCTION and needs --landing", file=sys.stderr)
        return NOTHING
    if args.backfill:
        queue = catalogue.backfill_queue(
            store.table("scheme_info"), store.table("nav_history"), args.backfill_category, args.backfill_fund_house, args.backfill
        )
        codes = [r.scheme_code for r in queue.select("scheme_code").collect()]
        if codes and args.fetcher:
            got = fetched(store, args, codes)
            lines.append(f"{len(got.landed)} histories fetched, {len(got.failed)} failed, {len(got.left)} left for want of time")
            if got.status == "failed":
                print(lines[-1], file=sys.stderr)
                return NOT_LOADED
        done = load_histories(store, codes, args.landing, args.today) if codes else None
        if done:
            lines.append(f"history of {len(done.loaded)} schemes loaded, {len(done.failed)} not landed; {done.rows} NAVs added")
            if not done.ok:
                print(lines[-1], file=sys.stderr)
                return NOT_LOADED
    store.expire("nav_history")
    store.expire("scheme_info")
    store.expire(snapshot.NAME)
    store.merge_events()
    seen = catalogue.statistics(store.table("scheme_info"), store.table("nav_history")).first().asDict()
    lines.append("; ".join(f"{k} {v}" for k, v in seen.items()))
    print("\n".join(lines))
    appended(args.summary_file, "\n".join(f"* {x}" for x in lines))
    return DONE


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if not argv or argv[0] not in ("analyse", "screen", "catalogue", "-h", "--help"):
        argv = ["analyse", *argv]
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return DONE if e.code == 0 else NOTHING
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run = {"analyse": run_analyse, "screen": run_screen, "catalogue": run_catalogue}[args.command]
    return run(Store(spark, args.root), args)


if __name__ == "__main__":
    sys.exit(main())
