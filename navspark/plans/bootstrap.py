"""First load of an empty store; never raises, tells what happened."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..operators import catalogue
from ..store import Store


@dataclass(frozen=True)
class BootstrapResult:
    status: str
    message: str = ""
    nav_rows: int = 0

    @property
    def ok(self) -> bool:
        return self.status in ("ready", "loaded")


def state(store: Store) -> dict[str, int]:
    """schemes, categories, fund_houses, analysable and nav_rows of the store."""
    return catalogue.statistics(store.table("scheme_info"), store.table("nav_history")).first().asDict()


def rows_in(store: Store) -> int:
    """A store that cannot be read counts as empty."""
    try:
        return state(store)["nav_rows"]
    except Exception:
        return 0


def ensure(store: Store, load: Callable[[Store], object], enabled: bool = True, force: bool = False) -> BootstrapResult:
    """ready: there are NAVs; skipped: loading is off; loaded or failed: by what load(store) left behind."""
    rows = rows_in(store)
    if rows and not force:
        return BootstrapResult("ready", nav_rows=rows)
    if not enabled:
        return BootstrapResult("skipped", "loading is switched off", rows)
    try:
        load(store)
    except Exception as e:
        return BootstrapResult("failed", str(e), rows)
    rows = rows_in(store)
    return BootstrapResult("loaded" if rows else "failed", "" if rows else "nothing was loaded", rows)
