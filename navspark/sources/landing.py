"""Fetching of histories on executors, landed as JSON lines for the parsers and the stream to read.

The fetching function is the caller's and runs in tasks, behind a data source that has a partition a group of schemes: each task
goes through its schemes with a schedule of tries, waits between them, and stops at the end of the time budget.  A task's file is
in place as soon as the task ends, whatever becomes of the job, so the landed lines are the offsets: a run that died and
is started again under its name fetches only what it has not landed.  At most ``lanes`` tasks ask at a time.
"""

from __future__ import annotations

import json
import os
import random
import socket
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LANDED, FAILED, LEFT = "landed", "failed", "left"
LINES = "scheme_code string, payload string, status string, message string, tries int, run string"


@dataclass
class LandingResult:
    landed: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)
    left: list[str] = field(default_factory=list)

    @property
    def status(self) -> str:
        return "failed" if not self.landed else "partial" if self.failed or self.left else "success"


def waits(tries: int, backoff: float, spread: Callable[[], float] = lambda: random.uniform(0.5, 1.5)) -> Iterator[float]:
    """Seconds before each try: none before the first, then growing twofold, spread at random."""
    yield 0.0
    for k in range(1, tries):
        yield backoff * 2 ** (k - 1) * spread()


def silence(host: str, port: int = 443, timeout: float = 5.0) -> str:
    """Why nothing answers at an address; empty if something does."""
    with socket.socket() as s:
        s.settimeout(timeout)
        try:
            code = s.connect_ex((host, port))
        except OSError as e:  # no such host
            return str(e)
    return os.strerror(code) if code else ""


@dataclass(frozen=True)
class Manners:
    """How a task asks: tries a scheme, seconds before the second try and between schemes, and until when (time.time())."""

    tries: int = 3
    backoff: float = 2.0
    delay: float = 1.0
    until: float = float("inf")


def asked(
    fetch: Callable[[str], dict], codes: Sequence[str], manners: Manners,
    clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep,
) -> Iterator[tuple[str, str | None, str, str | None, int]]:
    """(scheme_code, payload, status, message, tries) of each scheme; one that fails stops no other."""
    for at, code in enumerate(codes):
        if clock() >= manners.until:
            yield code, None, LEFT, None, 0
            continue
        said, n = "", 0
        for n, wait in enumerate(waits(manners.tries, manners.backoff), 1):
            if wait or at:
                sleep(wait or manners.delay)
            try:
                payload = json.dumps(fetch(code))
            except Exception as e:
                said = str(e)
            else:
                yield code, payload, LANDED, None, n
                break
        else:
            yield code, None, FAILED, f"gave up after {manners.tries} tries: {said}", n


@dataclass
class Group(InputPartition):
    codes: list[str]


def source_of(fetch: Callable[[str], dict], codes: Sequence[str], group: int, manners: Manners, run: str) -> type[DataSource]:
    """A data source of the schemes' histories, ``group`` of them a partition."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [Group(list(codes[a : a + group])) for a in range(0, len(codes), group)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            for row in asked(fetch, partition.codes, manners):
                yield *row, run

    class Histories(DataSource):
        @classmethod
        def name(cls) -> str:
            return "scheme_histories"

        def schema(self) -> str:
            return LINES

        def reader(self, schema: object) -> DataSourceReader:
            return Reader()

    return Histories


def _lines(spark: SparkSession, folder: str, run: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LINES)
    return spark.read.schema(LINES).json(folder).where(F.col("run") == run)


def land_histories(
    spark: SparkSession,
    fetch: Callable[[str], dict],
    codes: Sequence[str],
    folder: str,
    run: str,
    budget_seconds: float | None = None,
    lanes: int = 4,
    group: int = 25,
    delay: float = 1.0,
    tries: int = 3,
    backoff: float = 2.0,
) -> LandingResult:
    """Lines (scheme_code, payload, ...) in the folder; fetch(code) gives a payload with ``data``, an array of date and nav.

    run names the run: what an earlier attempt under this name landed is not fetched again.
    """
    until = float("inf") if budget_seconds is None else time.time() + budget_seconds
    have = {r[0] for r in _lines(spark, folder, run).where(F.col("status") == LANDED).select("scheme_code").distinct().collect()}
    due = [c for c in dict.fromkeys(codes) if c not in have]
    wave = lanes * group
    for a in range(0, len(due), wave):
        if time.time() >= until:
            break
        size = -(-len(due[a : a + wave]) // lanes)
        spark.dataSource.register(source_of(fetch, due[a : a + wave], min(group, size), Manners(tries, backoff, delay, until), run))
        rows = spark.read.format("scheme_histories").load()
        # this committer moves a task's file into place when the task ends
        rows.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").json(folder)
    ends = _lines(spark, folder, run).groupBy("scheme_code").agg(
        F.max(F.when(F.col("status") == LANDED, 1)).alias("landed"), F.max(F.when(F.col("status") == FAILED, F.col("message"))).alias("message")
    )
    seen = {r.scheme_code: r for r in ends.collect()}
    out = LandingResult()
    for code in dict.fromkeys(codes):
        if code in seen and seen[code].landed:
            out.landed.append(code)
        elif code in seen and seen[code].message:
            out.failed[code] = seen[code].message
        else:
            out.left.append(code)
    return out
