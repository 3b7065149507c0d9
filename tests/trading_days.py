"""Dates for the tests of the NAV engine."""

from __future__ import annotations

import datetime


def business_days(start: str, n: int) -> list[datetime.date]:
    day, out = datetime.date.fromisoformat(start), []
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day)
        day += datetime.timedelta(days=1)
    return out
