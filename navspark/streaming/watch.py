"""The quality gate on arriving rows: extreme moves, calendar gaps and late days, kept per scheme as the stream lands.

Keyed state holds a scheme's days and prices.  A batch's rows are put in by day, wherever they belong: a day that comes late splits a
gap or makes a move of its own, and a restated one replaces what it restates.  So what the stream reports of a scheme after any
number of batches is what the batch gate finds in the same rows, however they were dealt to files and in whatever
order those came.  The state is twelve bytes a day of a calendar; schemes are dealt to tasks by code.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT, EngineConfig
from ..sources import history

STATE = "days binary, navs binary, late long"
OUT = """scheme_code string, observations long, first_date date, last_date date, extreme long, worst_move double, worst_date date,
    gaps long, largest_gap int, late long, news long"""


def weekdays_before(day: np.ndarray) -> np.ndarray:
    """Mondays to Fridays before days since the epoch, from a fixed origin."""
    x = day - 4
    return 5 * (x // 7) + np.minimum(x % 7, 5)


def merged(days: np.ndarray, navs: np.ndarray, new_days: np.ndarray, new_navs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prices by day after new ones, given in the order of their arrival; the last of a day counts."""
    day, nav = np.r_[days, new_days], np.r_[navs, new_navs]
    order = np.argsort(day, kind="stable")
    day, nav = day[order], nav[order]
    last = np.r_[day[1:] != day[:-1], True]
    return day[last], nav[last]


def found(days: np.ndarray, navs: np.ndarray, config: EngineConfig = DEFAULT) -> tuple:
    """extreme, worst_move, worst_date (a day), gaps and largest_gap of a series of positive prices."""
    if len(days) < 2:
        return 0, None, None, 0, None
    move = np.abs(navs[1:] / navs[:-1] - 1) * 100
    gap = weekdays_before(days[1:]) - weekdays_before(days[:-1] + 1)
    worst = int(np.argmax(move))  # of equal moves the earliest
    return int((move > config.extreme_move_pct).sum()), float(move[worst]), int(days[1 + worst]), int((gap > config.max_gap_business_days).sum()), int(gap.max())


def watch(rows: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """rows: a stream of scheme_code, date, nav and history.ORDER, without bad rows (as history.parse gives them).

    After each batch, a row for each scheme in it: what the gate's checks of moves and gaps see in all that has arrived;
    ``late``, the rows that came after a later day of their scheme had; ``news``, the batch's rows.
    """
    epoch = pd.Timestamp("1970-01-01")

    def update(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (b"", b"", 0)
        days, navs, late = np.frombuffer(bytes(held[0]), np.int32).astype(np.int64), np.frombuffer(bytes(held[1]), np.float64), held[2]
        batch = pd.concat(list(parts)).sort_values(list(history.ORDER), kind="stable")
        new = ((pd.to_datetime(batch["date"]) - epoch).dt.days).to_numpy(np.int64)
        if len(days):
            late += int((new < days[-1]).sum())
        days, navs = merged(days, navs, new, batch["nav"].to_numpy(np.float64))
        state.update((days.astype(np.int32).tobytes(), navs.tobytes(), late))
        extreme, move, day, gaps, largest = found(days, navs, config)
        at = lambda d: None if d is None else (epoch + pd.Timedelta(days=int(d))).date()
        yield pd.DataFrame([(key[0], len(days), at(days[0]), at(days[-1]), extreme, move, at(day), gaps, largest, late, len(batch))],
                           columns=[c.split()[0] for c in OUT.replace("\n", " ").split(", ")])

    keyed = rows.select("scheme_code", "date", "nav", *history.ORDER).groupBy("scheme_code")
    return keyed.applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def watch_landing(spark, landing: str, max_files: int = 100, config: EngineConfig = DEFAULT) -> DataFrame:
    """watch() over a folder of landed payload files."""
    lines = spark.readStream.schema(history.LINES).option("maxFilesPerTrigger", max_files).json(landing)
    return watch(history.parse(history.with_files(lines)), config)
