"""Tables under a root path: Parquet folders a bucket of scheme codes and a month, made current by a commit log.

A day's feed holds every scheme but one month, so it rewrites that month's partitions and no other; a single scheme's history
touches one bucket.  A batch is staged once, then merged with the partitions that it touches in one shuffle, and its counts are
observed while it is written.  Writers do not lock: the version file is created only if it is absent, and who comes second
merges again if the other changed one of its partitions.  Readers open only partitions whose buckets and days they ask for.
"""

from __future__ import annotations

import datetime
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .commits import CommitLog, Files, Part
from .operators import merge

#: Of a new store: a month of some million schemes in so many files; more for larger tables.
BUCKETS = 16
TRIES = 30
TABLES = {"nav_history": schemas.NAV_HISTORY, "scheme_info": schemas.SCHEME_INFO}
PLACE = "bucket int, month int"


def tail(path: str) -> str:
    """A partition's folder under its table, however the file system spells the rest."""
    return "/".join(path.split("/")[-3:])


@dataclass(frozen=True)
class MergeResult:
    inserted: int
    updated: int


class Store:
    """nav_history, scheme_info and the audit events of ingestion runs.

    splits: files a partition is written in by as many tasks; the default suits partitions up to a few GB.  buckets: those of a
    new store; an old one keeps the number that it was made with.
    """

    def __init__(self, spark: SparkSession, root: str, splits: int = 1, buckets: int = BUCKETS):
        self.spark, self.root, self.splits = spark, root.rstrip("/"), splits
        self.files = Files(spark)
        made = f"{self.root}/_log/buckets"
        self.n_buckets = int(self.files.read(made)) if self.files.exists(made) else buckets

    def bucket_of(self, scheme_code: Column) -> Column:
        return F.pmod(F.xxhash64(scheme_code), F.lit(self.n_buckets)).cast("int")

    def placed(self, df: DataFrame, name: str) -> DataFrame:
        """df with the bucket and month of its rows."""
        month = F.year("date") * 100 + F.month("date") if name == "nav_history" else F.lit(0)
        return df.withColumns({"bucket": self.bucket_of(F.col("scheme_code")), "month": month})

    def log(self, name: str) -> CommitLog:
        return CommitLog(self.files, f"{self.root}/_log/{name}")

    def current(self, name: str) -> dict[tuple[int, int], str]:
        """The path of each (bucket, month) that holds rows."""
        return {k: p.path for k, p in self.log(name).state().parts.items()}

    def new_folder(self, name: str) -> str:
        return f"{self.root}/{name}/{uuid.uuid4().hex}"

    def buckets(self, codes: Iterable[str]) -> set[int]:
        rows = self.spark.createDataFrame([(c,) for c in codes], "scheme_code string")
        return {r[0] for r in rows.select(self.bucket_of(F.col("scheme_code"))).distinct().collect()}

    def _read(self, name: str, parts: Iterable[Part]) -> DataFrame:
        paths = [p.path for p in parts]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return schemas.conform(self.spark.read.parquet(*paths), TABLES[name])

    def table(
        self,
        name: str,
        codes: Iterable[str] | None = None,
        since: datetime.date | None = None,
        until: datetime.date | None = None,
        version: int | None = None,
    ) -> DataFrame:
        """A table's rows: all, those of some schemes, or those of some days.  Only files that may hold such rows, by the log's
        buckets and days, are opened.  None and no codes mean every scheme.  version: an earlier state, as long as it is kept."""
        codes = list(codes or ())
        wanted = self.buckets(codes) if codes else None
        parts = [
            p
            for p in self.log(name).state(version).parts.values()
            if (wanted is None or p.bucket in wanted)
            and (since is None or not p.last or p.last >= since.isoformat())
            and (until is None or not p.first or p.first <= until.isoformat())
        ]
        rows = self._read(name, parts)
        rows = rows.where(F.col("scheme_code").isin(codes)) if codes else rows
        rows = rows if since is None else rows.where(F.col("date") >= F.lit(since))
        return rows if until is None else rows.where(F.col("date") <= F.lit(until))

    @contextmanager
    def _staged(self, rows: DataFrame) -> Iterator[DataFrame]:
        """rows as a table of its own while they are merged, so that they are derived once however often that is tried."""
        path = f"{self.root}/_staging/{uuid.uuid4().hex}"
        try:
            rows.write.parquet(path)
            yield self.spark.read.schema(rows.schema).parquet(path)
        finally:
            self.files.delete(path)

    def _write(self, merged: DataFrame, name: str, days: bool) -> tuple[str, list[Part], MergeResult]:
        """Write merged rows with an ``action``; the parts in which some row has one, and the rows of each action."""
        path = self.new_folder(name)
        seen = Observation()
        counts = [F.count_if(F.col("action") == a).alias(a) for a in ("inserted", "updated")]
        try:
            merged.drop("split").observe(seen, *counts).write.partitionBy("bucket", "month").parquet(path)
            fields = [f.simpleString().replace(":", " ", 1) for f in merged.select("action", *(["date"] if days else [])).schema.fields]
            written = self.spark.read.schema(", ".join([*fields, PLACE])).parquet(path)
            ends = [f("date").cast("string") if days else F.lit("") for f in (F.min, F.max)]
            stats = written.groupBy("bucket", "month").agg(F.count("*").alias("rows"), ends[0].alias("first"), ends[1].alias("last"), F.count("action").alias("changed"))
            rows = stats.collect() if seen.get["inserted"] + seen.get["updated"] else []
            parts = []
            for r in rows:
                at = f"{path}/bucket={r.bucket}/month={r.month}"
                if r.changed:
                    parts.append(Part(r.bucket, r.month, at, r.rows, r["first"], r["last"]))
                else:
                    self.files.delete(at)
            if not parts:
                self.files.delete(path)
        except Exception:
            self.files.delete(path)
            raise
        return path, parts, MergeResult(seen.get["inserted"], seen.get["updated"])

    def _merge_in(self, name: str, staged: DataFrame, combine, days: bool, sources: dict[tuple[int, int], str] | None = None) -> MergeResult:
        """Merge staged rows (with bucket and month) until no other writer changed their partitions meanwhile."""
        made = f"{self.root}/_log/buckets"
        if not self.files.exists(made) and not self.files.create(made, str(self.n_buckets)):
            raise RuntimeError("the store was made by another writer meanwhile: open it again")
        touched = [tuple(r) for r in staged.select("bucket", "month").distinct().collect()]
        log = self.log(name)
        for _ in range(TRIES if touched else 0):
            base = log.state()
            old = self.placed(self._read(name, [base.parts[k] for k in touched if k in base.parts]), name)
            path, parts, counts = self._write(combine(old, staged), name, days)
            if sources:
                parts = [replace(p, source=sources.get(p.key, "")) for p in parts]
            while parts and not log.commit(base, parts):
                after = log.state()
                if any(after.parts.get(k) != base.parts.get(k) for k in touched):
                    break
                base = after  # the other writer was elsewhere
            else:
                return counts
            self.files.delete(path)
        if touched:
            raise RuntimeError(f"{name}: other writers were faster {TRIES} times")
        return MergeResult(0, 0)

    def _spread(self, *tables: DataFrame) -> DataFrame:
        """All rows, dealt by partition and split, in one exchange."""
        rows = tables[0]
        for t in tables[1:]:
            rows = rows.unionByName(t, allowMissingColumns=True)
        if self.splits > 1:
            rows = rows.withColumn("split", F.pmod(F.hash("scheme_code"), F.lit(self.splits)))
        return rows.repartition(*self.keys)

    @property
    def keys(self) -> list[str]:
        return ["bucket", "month", *(["split"] if self.splits > 1 else [])]

    def upsert_nav(self, batch: DataFrame, source: str, *order: str) -> MergeResult:
        """batch: scheme_code, date, nav and the order columns."""
        order = tuple(dict.fromkeys(order))
        rows = batch.where(merge.good()).select("scheme_code", "date", "nav", *[c for c in order if c not in ("scheme_code", "date", "nav")])

        def combine(old: DataFrame, new: DataFrame) -> DataFrame:
            return merge.merged(self._spread(*merge.both_sides(old, new, *order)), source, *self.keys, stamped=True)

        with self._staged(self.placed(rows, "nav_history")) as staged:
            return self._merge_in("nav_history", staged, combine, True)

    def upsert_info(self, batch: DataFrame, source: str, *order: str) -> int:
        """batch: scheme_code and any other column of scheme_info; names, sources and times are overwritten.  Of a scheme's rows
        the last counts, by the order columns.  The number of the batch's schemes, all of which are written."""
        rows = merge.last_of(batch, *order)
        rows = schemas.conform(rows, schemas.SCHEME_INFO).withColumns({"data_source": F.lit(source), "updated_at": F.current_timestamp()})
        keep = ["fund_house", "scheme_type", "scheme_category", "isin_growth", "isin_reinvest"]

        def combine(old: DataFrame, new: DataFrame) -> DataFrame:
            info = merge.merge_info(old.drop("bucket", "month"), new.drop("bucket", "month"), keep, ["scheme_name", "data_source", "updated_at"])
            mark = info.join(new.select("scheme_code", F.lit("updated").alias("action")), "scheme_code", "left")
            return self._spread(self.placed(mark, "scheme_info"))

        with self._staged(self.placed(rows, "scheme_info")) as staged:
            return self._merge_in("scheme_info", staged, combine, False).updated

    def rows_of(self, name: str, parts: Iterable[Part]) -> DataFrame:
        """The rows of some partitions, whatever is current."""
        return self._read(name, parts)

    def mirror_info(self, info: DataFrame) -> int:
        """Another store's schemes, with their sources and times, over this one's; the number of schemes."""
        columns = [f.name for f in schemas.SCHEME_INFO.fields if f.name != "scheme_code"]

        def combine(old: DataFrame, new: DataFrame) -> DataFrame:
            rows = merge.merge_info(old, new, [], columns)
            mark = rows.join(new.select("scheme_code", F.lit("updated").alias("action")), "scheme_code", "left")
            return self._spread(self.placed(mark, "scheme_info"))

        with self._staged(self.placed(schemas.conform(info, schemas.SCHEME_INFO), "scheme_info")) as staged:
            return self._merge_in("scheme_info", staged, combine, False).updated

    def take(self, parts: list[Part], rows: DataFrame) -> int:
        """Rows of another store's nav_history, which win over this one's whatever they hold; parts: where they come from.  Data and
        the note of what they are a copy of become current together.  The number of rows."""

        def combine(old: DataFrame, new: DataFrame) -> DataFrame:
            return merge.pushed(self._spread(*merge.both_sides(old, new, "data_source")), *self.keys, stamped=True)

        marks = {p.key: p.source for p in parts}
        with self._staged(self.placed(rows, "nav_history")) as staged:
            counts = self._merge_in("nav_history", staged, combine, True, marks)
        return counts.inserted + counts.updated

    def expire(self, name: str, keep: int = 2, grace: float = 86_400.0) -> int:
        """Delete partitions that none of the last ``keep`` versions reads, their log files, and folders that a failed writer
        left over ``grace`` seconds ago; the number of partitions deleted."""
        log = self.log(name)
        versions = log.versions()
        used = {tail(p.path) for v in versions[-keep:] for p in log.state(v).parts.values()}
        replaced = {tail(p.path) for v in versions for p in log.delta(v)} - used
        until, gone = (time.time() - grace) * 1000, 0
        for path, changed in self.files.found(f"{self.root}/{name}/*/bucket=*/month=*"):
            if tail(path) not in used and (changed < until or tail(path) in replaced):
                self.files.delete(path)
                gone += 1
        for path, changed in self.files.found(f"{self.root}/{name}/*"):
            if changed < until and not self.files.found(f"{path}/bucket=*/month=*"):
                self.files.delete(path)
        log.trim(keep)
        return gone

    @contextmanager
    def run(self, kind: str, run_id: str | None = None, **fields: object) -> Iterator[dict]:
        """An audited run: open while the block works, then closed with the fields that the block sets, or as failed."""
        run_id = run_id or uuid.uuid4().hex
        self.log_run(run_id, kind, 0, status="running", **fields)
        end: dict = {"status": "success"}
        try:
            yield end
        except BaseException as e:
            self.log_run(run_id, kind, 1, **{**fields, **end, "status": "failed", "message": f"{type(e).__name__}: {e}"[:500]})
            raise
        self.log_run(run_id, kind, 1, **{**fields, **end})

    def log_run(self, run_id: str, kind: str, seq: int, **fields: object) -> None:
        """Append an audit event; the one with the largest seq is a run's state."""
        row = {"run_id": run_id, "kind": kind, "seq": seq, "at": datetime.datetime.now(datetime.timezone.utc)} | fields
        line = schemas.as_json(schemas.RUN_EVENTS, row)
        self.files.write(f"{self.root}/ingestion_runs/{row['at']:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex}.json", line + "\n")

    def run_events(self) -> DataFrame:
        path = f"{self.root}/ingestion_runs"
        if not self.files.exists(path):
            return self.spark.createDataFrame([], schemas.RUN_EVENTS)
        return self.spark.read.schema(schemas.RUN_EVENTS).json(path).dropDuplicates(["run_id", "seq", "at"])

    def merge_events(self) -> int:
        """Put all audit events in one file; their number.  A crash in between leaves events twice, which are read once."""
        old = [p for p, _ in self.files.found(f"{self.root}/ingestion_runs/*.json")]
        if len(old) < 2:
            return 0
        lines = [line for p in sorted(old) for line in self.files.read(p).splitlines()]
        self.files.write(f"{self.root}/ingestion_runs/{uuid.uuid4().hex}.json", "\n".join(lines) + "\n")
        for p in old:
            self.files.delete(p)
        return len(lines)

    def recent_runs(self, limit: int = 10) -> DataFrame:
        return merge.latest_runs(self.run_events(), limit, "at")
