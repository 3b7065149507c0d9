"""Loading of a store: catalogue feed, landed histories, generated series; each load is an audited run."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import history, navall, synthetic
from ..store import MergeResult, Store


@dataclass(frozen=True)
class CatalogueResult:
    """parsed: entries; changed: rows written to the dimension; the NAVs' merge; what the feed holds."""

    parsed: int = 0
    categories: int = 0
    fund_houses: int = 0
    newest: datetime.date | None = None
    changed: int = 0
    navs: MergeResult = MergeResult(0, 0)
    error: str = ""


@dataclass(frozen=True)
class LoadResult:
    """Schemes whose histories came, that were generated, and that have neither."""

    loaded: list[str]
    generated: list[str]
    failed: list[str]
    rows: int
    error: str = ""

    @property
    def ok(self) -> bool:
        return bool(self.loaded or self.generated)


def missing(store: Store, path: str) -> str:
    """Why a path cannot be read; empty if something is there."""
    return "" if store.files.found(path) else f"nothing at {path}"


def refresh_catalogue(store: Store, feed: str, with_navs: bool = True) -> CatalogueResult:
    """The feed file's schemes into the dimension and, with_navs, its NAVs into the history; a feed that is missing or without
    an entry is an error and changes nothing."""
    with store.run("catalogue", message=feed) as end:
        error = missing(store, feed)
        seen = None
        if not error:
            entries, _ = navall.parse(navall.read_lines(store.spark, feed))
            entries = entries.persist()
            try:
                seen = entries.agg(
                    F.count("*"), F.count_distinct("scheme_category"), F.count_distinct("fund_house"), F.max("nav_date")
                ).first()
                if seen[0]:
                    changed = store.upsert_info(entries, "amfi")
                    navs = entries.where("nav is not null and nav_date is not null").select("scheme_code", F.col("nav_date").alias("date"), "nav")
                    merged = store.upsert_nav(navs, "amfi", "nav") if with_navs else MergeResult(0, 0)
            finally:
                entries.unpersist()
            error = "" if seen[0] else f"no entry in {feed}"
        if error:
            end |= {"status": "failed", "message": error}
            return CatalogueResult(error=error)
        end |= {"rows_written": merged.inserted, "rows_updated": merged.updated}
        return CatalogueResult(*seen, changed, merged)


def load_histories(
    store: Store,
    codes: list[str],
    landing: str | None,
    today: datetime.date,
    allow_synthetic: bool = False,
    synthetic_only: bool = False,
) -> LoadResult:
    """Landed payloads of the schemes (of all schemes, if codes is empty) into the history.  Series are generated, tagged
    as such, for schemes without a landed NAV (allow_synthetic) or for all (synthetic_only), never over real ones.  A landing
    folder that is missing lands nothing."""
    with store.run("ingest", schemes=",".join(codes)) as end:
        loaded: list[str] = []
        merged = made = MergeResult(0, 0)
        error = missing(store, landing) if landing and not synthetic_only else ""
        if landing and not synthetic_only and not error:
            rows = history.parse(history.read(store.spark, landing))
            rows = rows.where(F.col("scheme_code").isin(codes)) if codes else rows
            merged = store.upsert_nav(rows, "amfi", *history.ORDER)
            loaded = [r[0] for r in rows.select("scheme_code").distinct().orderBy("scheme_code").collect()]
        absent = sorted(set(codes) - set(loaded))
        generated: list[str] = []
        if absent and (allow_synthetic or synthetic_only):
            have = store.table("nav_history", absent).where(F.col("data_source") != "synthetic")
            real = {r[0] for r in have.select("scheme_code").distinct().collect()}
            generated = [c for c in absent if c not in real]
            if generated:
                schemes: DataFrame = store.spark.createDataFrame([(c,) for c in generated], "scheme_code string")
                made = store.upsert_nav(synthetic.generate(schemes, today), "synthetic", "nav")
        failed = [c for c in absent if c not in generated]
        out = LoadResult(loaded, generated, failed, merged.inserted + made.inserted, error)
        status = "failed" if not out.ok else "partial" if failed else "success"
        message = "; ".join(filter(None, [error, ",".join(failed)]))
        end |= {"status": status, "rows_written": out.rows, "rows_updated": merged.updated + made.updated, "message": message}
        return out
