"""Ranked observations for readers: a table of rules over the metric rows; integrity comes before performance."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..config import DEEP_DRAWDOWN_PCT, HIGH_VOLATILITY_PCT, INDEX_LIKE_R2, WEAK_SHARPE

#: Schemes that an insight names; all are counted.
KEPT = 25
#: Leaders: name, metric, whether the largest wins.
LEADERS = [
    ("best_sharpe", "sharpe_ratio", True),
    ("worst_sharpe", "sharpe_ratio", False),
    ("highest_cagr_3y", "cagr_3y_pct", True),
    ("deepest_drawdown", "max_drawdown_pct", False),
    ("highest_volatility", "volatility_pct", True),
    ("worst_rolling_3y", "rolling_3y_min_pct", False),
]


def leaders(metrics: DataFrame) -> DataFrame:
    """leader, scheme_code, value: the extreme scheme of each metric, ties to the smallest code; one aggregation."""
    aggs = []
    for name, metric, largest in LEADERS:
        value = F.col(metric) if largest else -F.col(metric)
        # numeric codes by their number, before all others by their text
        code = F.col("scheme_code").try_cast("long")
        key = F.when(F.col(metric).isNotNull(), F.struct((-value).alias("v"), code.isNull().alias("other"), code.alias("c"), F.col("scheme_code").alias("k")))
        aggs.append(F.min_by(F.struct("scheme_code", F.col(metric).alias("value")), key).alias(name))
    one = metrics.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("leader"), F.col(f"{n}.scheme_code").alias("scheme_code"), F.col(f"{n}.value").alias("value")) for n, _, _ in LEADERS])
    return one.select(F.explode(rows).alias("x")).select("x.*").where("scheme_code is not null")


@dataclass(frozen=True)
class Insight:
    """n: the schemes that it is about; scheme_codes: the first KEPT of them."""

    rank: int
    category: str
    headline: str
    detail: str
    scheme_codes: list[str] = field(default_factory=list)
    n: int = 0


@dataclass(frozen=True)
class Rule:
    """Rows that match ``where``, in ``order``; ``top`` rules tell of the first row only.  Texts may name {n}, {name} and
    {limit}; ``item`` is what is said of a row."""

    name: str
    category: str
    headline: str
    where: str
    order: str
    item: str
    top: bool = False
    limit: float | None = None


def _of_gate(name: str, text: str, where: str) -> Rule:
    return Rule(name, "data-integrity", text, where, "scheme_code", "scheme_code")


def _say(pattern: str, *columns: str) -> str:
    """SQL of a text with values at its {} marks, each given as column:format; a dash stands for a missing value."""
    texts = pattern.split("{}")
    parts = [f"'{texts[0]}'"]
    for column, text in zip(columns, texts[1:]):
        c, form = column.split(":")
        parts += [f"if({c} is null, '—', format_string('{form}', {c}))", f"'{text}'"]
    return f"concat({', '.join(parts)})"


#: In the order in which they are told; the first three, of the data, come before any of performance.
GATE_RULES = [
    _of_gate("excluded", "{n} scheme(s) are not analysed: their data failed a critical check", "severity = 'CRITICAL'"),
    _of_gate("stale", "{n} scheme(s) have had no NAV of late", "`check` = 'stale_data'"),
]
SYNTHETIC = _of_gate("synthetic", "{n} scheme(s) show generated numbers, which nobody can invest in", "data_source = 'synthetic'")
METRIC_RULES = [
    Rule("best", "performance", "{name} earned most for its risk", "sharpe_ratio is not null", "-sharpe_ratio",
         _say("Sharpe {}, Sortino {} at {} volatility", "sharpe_ratio:%.2f", "sortino_ratio:%.2f", "volatility_pct:%.2f%%"), top=True),
    Rule("weakest", "performance", "{name} earned least for its risk", "sharpe_ratio is not null", "sharpe_ratio",
         _say("Sharpe {}, short of {limit}", "sharpe_ratio:%.2f"), top=True, limit=WEAK_SHARPE),
    Rule("fastest", "performance", "{name} grew fastest over three years", "cagr_3y_pct is not null", "-cagr_3y_pct",
         _say("{} a year; a monthly plan made {}", "cagr_3y_pct:%.2f%%", "sip_xirr_3y_pct:%.2f%%"), top=True),
    Rule("deepest", "risk", "{name} lost most from a high", "max_drawdown_pct <= {limit}", "max_drawdown_pct",
         _say("{} between {} and {}, ", "max_drawdown_pct:%.1f%%", "max_drawdown_peak:%s", "max_drawdown_trough:%s")
         + " || if(max_drawdown_recovered, 'made good in ', 'open for ') || " + _say("{} days", "max_drawdown_days:%d"),
         top=True, limit=DEEP_DRAWDOWN_PCT),
    Rule("open", "risk", "{n} scheme(s) have not made good such a loss", "max_drawdown_pct <= {limit} and not max_drawdown_recovered",
         "max_drawdown_pct", "scheme_code", limit=DEEP_DRAWDOWN_PCT),
    Rule("below", "risk", "{n} scheme(s) trade more than 5% below a past high", "current_drawdown_pct < -5", "current_drawdown_pct",
         _say("{} {}", "scheme_name:%s", "current_drawdown_pct:%.1f%%")),
    Rule("volatile", "risk", "{n} scheme(s) swing by more than {limit}% a year", "volatility_pct > {limit}", "-volatility_pct",
         _say("{} {}, {} on a bad day", "scheme_name:%s", "volatility_pct:%.1f%%", "var_95_pct:%.2f%%"), limit=HIGH_VOLATILITY_PCT),
    Rule("alpha", "benchmark", "{name} added most to its benchmark", "alpha_pct is not null", "-alpha_pct",
         _say("alpha {} at beta {}, tracking error {}, information ratio {}", "alpha_pct:%+.2f%%", "beta:%.2f", "tracking_error_pct:%.2f%%",
              "information_ratio:%.2f"), top=True),
    Rule("behind", "benchmark", "{n} scheme(s) fell short of the benchmark in the last year", "alpha_pct is not null and excess_return_1y_pct < 0",
         "excess_return_1y_pct", _say("{} by {} points", "scheme_name:%s", "-excess_return_1y_pct:%.2f")),
    Rule("index", "benchmark", "{n} scheme(s) hold what an index holds, to judge by their moves", "alpha_pct is not null and r_squared > {limit}",
         "-r_squared", _say("{}, R2 {}", "scheme_name:%s", "r_squared:%.3f"), limit=INDEX_LIKE_R2),
    Rule("exposed", "benchmark", "{n} scheme(s) fall further than the benchmark when it falls", "alpha_pct is not null and down_capture_pct > 105",
         "-down_capture_pct", _say("{} takes {} of it", "scheme_name:%s", "down_capture_pct:%.0f%%")),
    Rule("rolling", "consistency", "Any three years: {name} had the worst of them", "rolling_3y_min_pct is not null", "rolling_3y_min_pct",
         _say("{} between {} and {} a year, half over {}, a gain in {} of them", "scheme_name:%s", "rolling_3y_min_pct:%.1f%%",
              "rolling_3y_max_pct:%.1f%%", "rolling_3y_median_pct:%.1f%%", "rolling_3y_positive_share_pct:%.0f%%")),
    Rule("trend", "trend", "{n} scheme(s) stand below their 50-day average", "sma_signal = 'BEARISH'", "nav_vs_sma50_pct",
         _say("{} {}", "scheme_name:%s", "nav_vs_sma50_pct:%.1f%%")),
]
#: Told in the detail of the rule before it, not as an insight of its own.
INSIDE = {"open": "deepest"}


def matches(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule (its place), o, scheme_code, name, item: the first KEPT matching rows of each rule; n: how many match.

    Each task keeps its own first rows before any is exchanged, so a rule that a million schemes match sends KEPT rows a
    task; the numbers are exact."""

    def matched(i: int, r: Rule) -> Column:
        fill = lambda text: text.replace("{limit}", f"{r.limit:g}" if r.limit is not None else "")
        order = F.expr(r.order)
        row = F.struct(
            F.lit(i).alias("rule"), (F.lit(0.0) if r.order == "scheme_code" else order.cast("double")).alias("o"),
            "scheme_code", "name", F.expr(fill(r.item)).alias("item"),
        )
        return F.when(F.expr(fill(r.where)), row)

    found = rows.select(F.explode(F.array_compact(F.array(*[matched(i, r) for i, r in enumerate(rules)]))).alias("x")).select("x.*")
    if any(r.category == "data-integrity" and r.name in ("excluded", "stale") for r in rules):
        found = found.dropDuplicates(["rule", "scheme_code"])  # the gate may find several things in a scheme
    first = Window.partitionBy("rule").orderBy("o", "scheme_code")
    kept = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= KEPT)
    counts = found.groupBy("rule").agg(F.count("*").alias("n"))
    return kept.join(counts, "rule")


def _told(rows: DataFrame, rules: list[Rule]) -> dict[str, list[Row]]:
    """The kept rows of each rule, in order; at most KEPT a rule."""
    found = sorted(matches(rows, rules).collect(), key=lambda r: (r.rule, r.place))
    return {rule.name: [r for r in found if r.rule == i] for i, rule in enumerate(rules)}


def derive(metrics: DataFrame, findings: DataFrame) -> list[Insight]:
    """The rules' observations, integrity before performance; metrics: named metric rows, findings: of the quality gate."""
    rules = [SYNTHETIC, *GATE_RULES, *METRIC_RULES]
    told = _told(metrics.withColumn("name", F.col("scheme_name")), [SYNTHETIC, *METRIC_RULES])
    told |= _told(findings.withColumn("name", F.col("scheme_code")), GATE_RULES)
    best = [r.scheme_code for r in told["best"][:1]]
    out: list[Insight] = []
    for rule in rules:
        rows = told[rule.name]
        if rule.top:
            rows = rows[:1]
        if rule.name == "weakest":
            rows = [r for r in rows if r.o < WEAK_SHARPE and r.scheme_code not in best]
        if not rows or rule.name in INSIDE:
            continue
        n = 1 if rule.top else rows[0].n
        detail = "; ".join(r.item for r in rows) + (f"; and {n - len(rows)} more" if n > len(rows) else "")
        if rule.name == "fastest" and best and rows[0].scheme_code not in best:
            detail += "; not the one that earned most for its risk"
        for name in [x for x, of in INSIDE.items() if of == rule.name and told[x]]:
            more, inside = told[name], next(r for r in rules if r.name == name)
            rest = f" and {more[0].n - len(more)} more" if more[0].n > len(more) else ""
            detail += f"; {inside.headline.format(n=more[0].n)}: {', '.join(r.item for r in more)}{rest}"
        limit = "" if rule.limit is None else f"{rule.limit:g}"
        head = rule.headline.format(n=n, name=rows[0].name, limit=limit)
        out.append(Insight(len(out) + 1, rule.category, head, detail, [r.scheme_code for r in rows], n))
    return out
