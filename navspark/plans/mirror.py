"""The push of a store's recent history to a mirror: one way, in batches, resumable.

A batch is a number of the source's partitions.  It is staged under the mirror's root and merged by key, and the mirror's commit
notes with each partition which file of the source it is a copy of.  That note is the high-water mark: it becomes current together
with the data, so a push that died goes on behind its last batch, and the next push moves only what changed since.  Rows of the
source always win; rows that the mirror has beside them stay, those before the horizon included.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from ..commits import Part
from ..config import DAYS_PER_YEAR, DEFAULT
from ..store import Store

BATCH_ROWS = 50_000_000


@dataclass(frozen=True)
class PushResult:
    since: datetime.date
    schemes: int
    rows: int
    batches: int
    skipped: int


def horizon(today: datetime.date, years: float) -> datetime.date:
    return today - datetime.timedelta(days=round(years * DAYS_PER_YEAR))


def due(source: Store, mirror: Store, since: datetime.date) -> tuple[list[Part], int]:
    """The source's partitions with days of the slice that the mirror has no copy of, and the number of those that it has."""
    have = mirror.log("nav_history").state().parts
    wanted = []
    for p in source.log("nav_history").state().parts.values():
        if p.last >= since.isoformat():
            # a partition across the horizon is another slice each day
            mark = p.path if p.first >= since.isoformat() else f"{p.path} since {since}"
            wanted.append(replace(p, source=mark))
    left = [p for p in wanted if p.key not in have or have[p.key].source != p.source]
    return sorted(left, key=lambda p: (p.month, p.bucket)), len(wanted) - len(left)


def batches(parts: list[Part], rows: int) -> Iterator[list[Part]]:
    """Parts in groups of at most ``rows`` rows, one part at least."""
    group: list[Part] = []
    for p in parts:
        if group and sum(x.rows for x in group) + p.rows > rows:
            yield group
            group = []
        group.append(p)
    if group:
        yield group


def push(source: Store, mirror: Store, today: datetime.date, years: float = DEFAULT.mirror_years, batch_rows: int = BATCH_ROWS) -> PushResult:
    """All schemes and the NAVs of the last years.  The push and each of its batches are audited runs of the mirror; an error
    closes both as failed and goes on to the caller."""
    if mirror.current("nav_history") and source.n_buckets != mirror.n_buckets:
        raise ValueError(f"the mirror has {mirror.n_buckets} buckets, the source {source.n_buckets}")
    mirror.n_buckets = source.n_buckets
    since, push_id = horizon(today, years), uuid.uuid4().hex
    with mirror.run("push", push_id, message=f"since {since}") as end:
        info = source.table("scheme_info")
        schemes = mirror.mirror_info(info)
        parts, skipped = due(source, mirror, since)
        rows = n = 0
        for n, group in enumerate(batches(parts, batch_rows), 1):
            with mirror.run("push-batch", f"{push_id}-{n}") as done:
                slice_ = source.rows_of("nav_history", group).where(F.col("date") >= F.lit(since))
                moved = mirror.take(group, slice_)
                last = group[-1]
                done |= {"rows_written": moved, "message": f"to month {last.month}, bucket {last.bucket}"}
            rows += moved
        end |= {"rows_written": rows}
        return PushResult(since, schemes, rows, n, skipped)
