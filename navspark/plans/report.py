"""Reports from an analysis: Markdown, HTML with inline charts, JSON and CSV, and a console table."""

from __future__ import annotations

import csv
import datetime
import html
import json
from pathlib import Path

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators import returns, risk, validation
from .analysis import Analysis
from .insights import Insight

SHOWN = [
    "scheme_code", "scheme_name", "latest_nav", "return_1y_pct", "cagr_3y_pct", "cagr_5y_pct", "volatility_pct",
    "sharpe_ratio", "max_drawdown_pct", "sip_xirr_3y_pct", "sma_signal",
]

#: Schemes drawn in a chart; the title says so where there are more.
CHARTED = 12


def cell(v: object) -> str:
    return "—" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)


def markdown(rows: list[Row], findings: list[Row], insights: list[Insight], assumptions: dict[str, object]) -> str:
    out = ["# Fund report", "", "## What to notice", ""]
    out += [f"{i.rank}. **{i.headline}** ({i.category}): {i.detail}" for i in insights] or ["Nothing."]
    out += ["", "## Metrics", "", "| " + " | ".join(SHOWN) + " |", "|" + " --- |" * len(SHOWN)]
    out += ["| " + " | ".join(cell(r[c]) for c in SHOWN) + " |" for r in rows]
    out += ["", "## Data quality", "", "| scheme | severity | check | message |", "| --- | --- | --- | --- |"]
    out += [f"| {f.scheme_code} | {f.severity} | {f.check} | {f.message} |" for f in findings]
    out += ["", "## Assumptions", "", *(f"- {k}: {v}" for k, v in assumptions.items()), ""]
    return "\n".join(out)


def jsonable(v: object) -> object:
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [jsonable(x) for x in v]
    if isinstance(v, float) and v != v:
        return None
    return v


def as_json(rows: list[Row], findings: list[Row], insights: list[Insight], assumptions: dict[str, object]) -> str:
    plain = lambda r: {k: jsonable(v) for k, v in r.asDict().items()}
    return json.dumps(
        {"schemes": [plain(r) for r in rows], "findings": [plain(f) for f in findings],
         "insights": [vars(i) for i in insights], "assumptions": assumptions}, indent=2,
    )


def chart(series: dict[str, list[tuple[datetime.date, float]]], title: str, width: int = 900, height: int = 320) -> str:
    """Inline SVG with a line a scheme."""
    points = [p for s in series.values() for p in s]
    if not points:
        return ""
    x0, x1 = min(p[0] for p in points).toordinal(), max(p[0] for p in points).toordinal()
    y0, y1 = min(p[1] for p in points), max(p[1] for p in points)
    sx, sy = (width - 20) / max(1, x1 - x0), (height - 40) / ((y1 - y0) or 1)
    lines = []
    for k, (name, s) in enumerate(sorted(series.items())):
        path = " ".join(f"{10 + (d.toordinal() - x0) * sx:.1f},{height - 10 - (v - y0) * sy:.1f}" for d, v in s)
        lines.append(f'<polyline fill="none" stroke="hsl({k * 67 % 360},60%,45%)" points="{path}"><title>{html.escape(name)}</title></polyline>')
    return f'<figure><figcaption>{html.escape(title)}</figcaption><svg viewBox="0 0 {width} {height}">{"".join(lines)}</svg></figure>'


def collected(series: DataFrame, value: str) -> dict[str, list[tuple[datetime.date, float]]]:
    """Decimated points by scheme; for the few schemes of a report."""
    out: dict[str, list] = {}
    for r in returns.decimate(series).orderBy("scheme_code", "date").collect():
        out.setdefault(r.scheme_code, []).append((r.date, r[value]))
    return out


def as_html(text: str, charts: list[str], rows: list[Row]) -> str:
    head = "".join(f"<th>{c}</th>" for c in SHOWN)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(cell(r[c]))}</td>" for c in SHOWN) + "</tr>" for r in rows)
    return (
        "<!doctype html><meta charset='utf-8'><title>Fund report</title>"
        f"<table><tr>{head}</tr>{body}</table>{''.join(charts)}<pre>{html.escape(text)}</pre>"
    )


def console(rows: list[Row]) -> str:
    table = [SHOWN, *([cell(r[c]) for c in SHOWN] for r in rows)]
    wide = [max(len(r[i]) for r in table) for i in range(len(SHOWN))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, wide)) for r in table)


def write_reports(analysis: Analysis, nav: DataFrame, out: str) -> list[str]:
    """report.md, index.html, report.json and, with schemes, fund_metrics.csv in a local folder."""
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    rows, findings = analysis.rows(), validation.sorted_findings(analysis.findings).collect()
    insights, assumptions = analysis.insights(), vars(analysis.config)
    text = markdown(rows, findings, insights, assumptions)
    codes = [r.scheme_code for r in rows]
    shown = nav.where(F.col("scheme_code").isin(codes[:CHARTED]))
    some = f", the first {CHARTED} of {len(codes)} schemes" if len(codes) > CHARTED else ""
    charts = [chart(collected(returns.growth(shown), "growth"), f"Growth{some}"), chart(collected(risk.drawdown_series(shown), "drawdown_pct"), f"Drawdown{some}")] if codes else []
    files = {"report.md": text, "index.html": as_html(text, charts, rows), "report.json": as_json(rows, findings, insights, assumptions)}
    for name, content in files.items():
        (folder / name).write_text(content)
    if rows:
        with (folder / "fund_metrics.csv").open("w", newline="") as f:
            w = csv.writer(f)
            w.writerow(rows[0].asDict())
            w.writerows([["" if v is None else v for v in r] for r in rows])
    return [*files, *(["fund_metrics.csv"] if rows else [])]
