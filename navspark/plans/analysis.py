"""The analysis: load, gate, clean, measure; lazy until the metric rows are collected for a report."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..operators import validation
from ..panel import clean_series, load_panel, selected
from . import bundle
from .insights import Insight, derive


@dataclass
class Analysis:
    metrics: DataFrame
    findings: DataFrame
    coverage: DataFrame
    config: EngineConfig

    def rows(self) -> list[Row]:
        """A row a requested scheme."""
        return self.metrics.orderBy("scheme_code").collect()

    def insights(self) -> list[Insight]:
        return derive(self.metrics, self.findings)

    def ranked_by(self, metric: str, descending: bool = True) -> DataFrame:
        order = F.col(metric).desc() if descending else F.col(metric).asc()
        return self.metrics.where(F.col(metric).isNotNull()).orderBy(order, "scheme_code")


def analyse(
    nav: DataFrame,
    info: DataFrame,
    today: datetime.date,
    scheme_codes: list[str] | None = None,
    benchmark: str | None = None,
    config: EngineConfig = DEFAULT,
    *order: str,
) -> Analysis:
    """Metrics of the requested schemes (None, []: of all) that pass the gate.  The benchmark is loaded and checked, but reported only if
    requested, and used even if it fails the gate.  Of repeated days the last counts, by the order columns (by default
    ``updated_at``, where nav has it), then the larger NAV."""
    codes = sorted({*scheme_codes, *([benchmark] if benchmark else [])}) if scheme_codes else None
    keep = selected(nav, codes)
    panel = load_panel(keep, info)
    expected = None
    if codes:
        expected = nav.sparkSession.createDataFrame([(c,) for c in codes], "scheme_code string")
    found = validation.findings(panel, today, config, expected)
    order = (*(order or [c for c in ("updated_at",) if c in nav.columns]), "nav")
    clean = clean_series(keep.select("scheme_code", "date", "nav", "data_source", *[c for c in order if c != "nav"]), *order)
    metrics = bundle.scheme_metrics(clean, benchmark, config)
    metrics = metrics.join(validation.unusable(found), "scheme_code", "left_anti")
    metrics = selected(metrics, scheme_codes)
    names = info.select("scheme_code", "scheme_name", "fund_house", "scheme_category")
    named = metrics.join(names, "scheme_code", "left").withColumn(
        "scheme_name", F.coalesce("scheme_name", F.concat(F.lit("Unknown scheme "), "scheme_code"))
    )
    return Analysis(named, found, validation.coverage(panel, today, config), config)
