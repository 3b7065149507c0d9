"""The metric rows as a stored table, kept up to date bucket by bucket.

Each bucket's rows carry a mark of what they were worked out from: the bucket's NAV files, as the store's log names them, and the
settings.  A refresh works out only buckets whose mark differs, so a feed for some schemes costs those schemes' buckets, and
readers (ranks, scores, screens) scan metric rows instead of deriving them from the NAVs each time.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..commits import Part
from ..config import DEFAULT, EngineConfig
from ..panel import clean_series
from ..store import Store
from . import bundle

NAME = "scheme_metrics"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the cluster's (spark.checkpoint.dir); only where all tasks run on one machine and none is set, a
    temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="navspark-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def marks(store: Store, config: EngineConfig) -> dict[int, str]:
    """What each bucket's metrics have to be worked out from."""
    files: dict[int, list[str]] = {}
    for p in store.log("nav_history").state().parts.values():
        files.setdefault(p.bucket, []).append(p.path)
    told = repr(sorted(asdict(config).items()))
    return {b: hashlib.sha256("\n".join([told, *sorted(paths)]).encode()).hexdigest() for b, paths in files.items()}


def stale(store: Store, config: EngineConfig = DEFAULT) -> dict[int, str]:
    """The buckets to work out, with their marks."""
    have = store.log(NAME).state().parts
    return {b: m for b, m in marks(store, config).items() if have.get((b, 0)) is None or have[b, 0].source != m}


def refresh(store: Store, config: EngineConfig = DEFAULT) -> int:
    """Bring the stored metrics up to date; the number of buckets worked out.  If NAVs change meanwhile, the marks tell the
    next refresh."""
    due = stale(store, config)
    if not due:
        return 0
    parts = [p for p in store.log("nav_history").state().parts.values() if p.bucket in due]
    rows = bundle.scheme_metrics(clean_series(store.rows_of("nav_history", parts), "updated_at", "nav"), config=config)
    path = store.new_folder(NAME)
    placed = rows.withColumns({"bucket": store.bucket_of(F.col("scheme_code")), "month": F.lit(0)})
    placed.repartition("bucket").write.partitionBy("bucket", "month").parquet(path)
    written = store.spark.read.schema("bucket int, month int").parquet(path).groupBy("bucket").count().collect()
    made = {r.bucket: Part(r.bucket, 0, f"{path}/bucket={r.bucket}/month=0", r["count"], source=due[r.bucket]) for r in written}
    empty = [Part(b, 0, "", 0, source=m) for b, m in due.items() if b not in made]
    log = store.log(NAME)
    while not log.commit(log.state(), [*made.values(), *empty]):
        pass
    return len(due)


def metrics(store: Store, config: EngineConfig = DEFAULT) -> DataFrame:
    """The metric rows of all stored schemes, up to date."""
    refresh(store, config)
    paths = [p.path for p in store.log(NAME).state().parts.values() if p.rows]
    if not paths:
        return bundle.scheme_metrics(clean_series(store.rows_of("nav_history", []), "updated_at", "nav"), config=config)
    return store.spark.read.parquet(*paths)
