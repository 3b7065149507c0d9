"""Settings and thresholds of the engine (fixed values of the domain)."""

from __future__ import annotations

from dataclasses import dataclass

TRADING_DAYS = 252
DAYS_PER_YEAR = 365.25
MIN_OBS_VOLATILITY = 20
MIN_OBS_REGRESSION = 60
MIN_ROLLING_WINDOWS = 5
MIN_CAPTURE_MONTHS = 3
MIN_PEERS = 5
PEER_CAP = 400
SHORT_WINDOW, LONG_WINDOW = 50, 200

#: Calendar days of the trailing horizons, as round(years * 365.25).
HORIZON_DAYS = {"3m": 91, "6m": 183, "1y": 365, "3y": 1096, "5y": 1826}

#: Schemes analysed where none are asked for.
DEFAULT_SCHEMES = ("119598", "125497", "120503")

HIGH_VOLATILITY_PCT, WEAK_SHARPE, DEEP_DRAWDOWN_PCT, INDEX_LIKE_R2 = 20.0, 0.3, -15.0, 0.95


@dataclass(frozen=True)
class EngineConfig:
    risk_free: float = 0.065
    sip_amount: float = 10_000.0
    growth_base: float = 10_000.0
    max_staleness_days: int = 7
    extreme_move_pct: float = 20.0
    max_gap_business_days: int = 5
    min_observations: int = 30
    mirror_years: float = 5.0
    universe: tuple[str, ...] = DEFAULT_SCHEMES

    @property
    def daily_risk_free(self) -> float:
        return (1 + self.risk_free) ** (1 / TRADING_DAYS) - 1


DEFAULT = EngineConfig()
