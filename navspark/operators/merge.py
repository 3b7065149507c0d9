"""Row-level merges on plain DataFrames: NAV upsert, dimension upsert, mirror slice, audit events."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DAYS_PER_YEAR, DEFAULT


def good() -> Column:
    """Rows that a NAV table takes: a day, and a positive number."""
    return F.col("date").isNotNull() & (F.col("nav") > 0) & ~F.isnan("nav")


def both_sides(existing: DataFrame, batch: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a NAV table and of a batch in one form each, to be put together under their keys: the values as ``_old`` or as
    ``_new``, which begins with what orders a batch's rows of one key."""
    keys = ["scheme_code", "date", *[c for c in ("bucket", "month") if c in existing.columns]]
    stamp = ["updated_at"] if "updated_at" in existing.columns else []
    ranks = F.struct(*[F.col(c) for c in order]) if order else F.lit(0)
    more = ["data_source"] if "data_source" in batch.columns else []
    old = existing.select(*keys, F.struct("nav", "data_source", *stamp).alias("_old"))
    return old, batch.select(*keys, F.struct(ranks.alias("order"), "nav", *more).alias("_new"))


def merged(sides: DataFrame, source: str, *keys: str, stamped: bool = False) -> DataFrame:
    """The table after an upsert, with an ``action``: one aggregation, by a distribution that may be coarser than its keys."""
    rows = sides.groupBy("scheme_code", "date", *keys).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    changed = F.col("_new").isNotNull() & (F.col("_old.nav") != F.col("_new.nav"))
    action = F.when(F.col("_old").isNull(), "inserted").when(changed, "updated")
    return _after(rows, action, F.lit(source), keys, stamped)


def pushed(sides: DataFrame, *keys: str, stamped: bool = False) -> DataFrame:
    """As merged, but the batch's rows win whatever they hold, and keep their own sources and the table's times."""
    rows = sides.groupBy("scheme_code", "date", *keys).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    action = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNotNull(), "updated")
    return _after(rows, action, F.col("_new.data_source"), keys, stamped, F.coalesce("_old.updated_at", F.current_timestamp()) if stamped else None)


def _after(rows: DataFrame, action: Column, source: Column, keys: tuple[str, ...], stamped: bool, when: Column | None = None) -> DataFrame:
    new = action.isNotNull()
    stamp = F.when(new, F.current_timestamp() if when is None else when).otherwise(F.col("_old.updated_at")).alias("updated_at") if stamped else None
    return rows.select(
        "scheme_code", "date", F.when(new, F.col("_new.nav")).otherwise(F.col("_old.nav")).alias("nav"),
        F.when(new, source).otherwise(F.col("_old.data_source")).alias("data_source"),
        *([stamp] if stamped else []), action.alias("action"), *keys,
    )


def merge_nav(existing: DataFrame, batch: DataFrame, source: str, *order: str) -> DataFrame:
    """The NAV table after an upsert, with an ``action``: inserted, updated, or NULL for rows left alone.

    Bad rows of the batch go; its last row of a key, in the order of the order columns, counts.  A row whose NAV does
    not change keeps its provenance.  An ``updated_at`` of the table is set for rows that change.  Both tables meet in one
    exchange, and a key's rows in one aggregation.
    """
    old, new = both_sides(existing, batch.where(good()).drop("data_source"), *order)
    return merged(old.unionByName(new, allowMissingColumns=True), source, stamped="updated_at" in existing.columns)


def push_nav(mirror: DataFrame, rows: DataFrame) -> DataFrame:
    """The mirror after rows of the source were pushed to it, with an ``action``; rows that it has beside them stay."""
    old, new = both_sides(mirror, rows, "data_source")
    return pushed(old.unionByName(new, allowMissingColumns=True), stamped="updated_at" in mirror.columns)


def merge_counts(merged: DataFrame) -> DataFrame:
    """One row: inserted and updated."""
    return merged.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("inserted", "updated")])


def last_of(batch: DataFrame, *order: str) -> DataFrame:
    """One row a scheme_code: the last in the order of the order columns, then of all columns."""
    rest = [c for c in batch.columns if c != "scheme_code"]
    ranked = F.struct(*order, *[c for c in rest if c not in order])
    kept = batch.where("scheme_code is not null").groupBy("scheme_code").agg(F.max(ranked).alias("_last"))
    return kept.select("scheme_code", *[F.col("_last").getField(c).alias(c) for c in rest])


def merge_info(existing: DataFrame, batch: DataFrame, keep_old: list[str], overwrite: list[str], *order: str) -> DataFrame:
    """The dimension after an upsert by scheme_code: keep_old columns keep the old value where the new one is NULL.  Of a
    scheme's rows in the batch the last counts (last_of)."""
    old = existing.select("scheme_code", *[F.col(c).alias(f"_old_{c}") for c in keep_old + overwrite])
    new = last_of(batch.select("scheme_code", *dict.fromkeys([*keep_old, *overwrite, *order])), *order)
    both = new.withColumn("_new", F.lit(True)).join(old, "scheme_code", "full_outer")
    columns = [F.coalesce(F.col(c), F.col(f"_old_{c}")).alias(c) for c in keep_old]
    columns += [F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) for c in overwrite]
    return both.select("scheme_code", *columns)


def mirror_slice(nav: DataFrame, today: datetime.date, years: float = DEFAULT.mirror_years) -> DataFrame:
    """The rows that the mirror holds: those within the last years."""
    cutoff = today - datetime.timedelta(days=round(years * DAYS_PER_YEAR))
    return nav.where(F.col("date") >= F.lit(cutoff))


def mirror_check(nav: DataFrame) -> DataFrame:
    """One row: rows, schemes, first_date and last_date of a mirror."""
    return nav.agg(
        F.count("*").alias("rows"), F.count_distinct("scheme_code").alias("schemes"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )


def latest_runs(events: DataFrame, limit: int = 10, time: str = "at") -> DataFrame:
    """Audit events (run_id, seq, ...) to the latest state of each run, newest first: by the time of its first event.

    time: the column that tells when an event was written; ``started_at`` is a run's first.
    """
    rest = [c for c in events.columns if c != "run_id"]
    runs = events.groupBy("run_id").agg(F.max_by(F.struct(*rest), F.struct("seq", time)).alias("e"), F.min(time).alias("started_at"))
    rows = runs.select("run_id", "e.*", "started_at")
    return rows.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(limit)
