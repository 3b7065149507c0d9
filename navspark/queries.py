"""One query per operator on the driver's star-schema tables, with equivalent SQL for the oracle.

Computed doubles are rounded on both sides, since sums run in different orders.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT
from .operators import benchmark as bm
from .operators import catalogue, merge, peers, returns, risk, rolling, screener, sip, validation
from .panel import clean_series, event_nav, load_panel, star_info, star_lines, star_nav, star_tasks
from .plans import bundle, insights
from .plans.analysis import Analysis
from .plans.snapshot import settled, shared_folder
from .sources import history, navall
from .store import Store

TODAY = datetime.date(2001, 11, 5)
BENCHMARK = "1"
RD = repr(DEFAULT.daily_risk_free)
Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}

# Common table expressions of the oracle, each after those that it uses.
CTES = {
    "nav": """SELECT CAST(l_suppkey AS VARCHAR) AS scheme_code, CAST(l_shipdate AS DATE) AS date,
        CAST((sum(CAST(round(l_extendedprice * 100) AS BIGINT)) * 200 + sum(CAST(round(l_quantity) AS BIGINT)))
        // (sum(CAST(round(l_quantity) AS BIGINT)) * 2) AS BIGINT) / 10000.0::DOUBLE AS nav,
        CASE WHEN l_suppkey % 7 = 0 THEN 'synthetic' ELSE 'amfi' END AS data_source
        FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "info": """SELECT CAST(s_suppkey AS VARCHAR) AS scheme_code, s_name AS scheme_name, n_name AS fund_house,
        r_name AS scheme_category FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "lines": """SELECT CAST(l_suppkey AS VARCHAR) AS scheme_code, CAST(l_shipdate AS DATE) AS date,
        (CAST(round(l_extendedprice * 100) AS BIGINT) * 200 + CAST(round(l_quantity) AS BIGINT))
        // (CAST(round(l_quantity) AS BIGINT) * 2) / 10000.0::DOUBLE AS nav, l_orderkey AS s1, l_linenumber AS s2, l_extendedprice AS s3
        FROM lineitem""",
    "clean": """SELECT scheme_code, date, nav FROM (SELECT *, row_number() OVER (PARTITION BY scheme_code, date
        ORDER BY s1 DESC, s2 DESC, s3 DESC) AS n FROM lines) WHERE n = 1 AND nav > 0""",
    "ret": """SELECT * FROM (SELECT scheme_code, date, nav,
        nav / lag(nav) OVER (PARTITION BY scheme_code ORDER BY date) - 1 AS r FROM nav) WHERE r IS NOT NULL""",
    "horizons": """SELECT * FROM (VALUES ('3m', 91), ('6m', 183), ('1y', 365), ('3y', 1096), ('5y', 1826)) AS h(h, days)""",
    "ends": """SELECT scheme_code, max(date) AS end_date, arg_max(nav, date) AS e, min(date) AS first_date,
        arg_min(nav, date) AS s, count(*) AS n, max(nav) AS top FROM nav GROUP BY scheme_code""",
    "starts": """SELECT n.scheme_code, h, max(n.date) AS d, arg_max(n.nav, n.date) AS s FROM nav n
        JOIN ends USING (scheme_code) CROSS JOIN horizons WHERE n.date <= end_date - days GROUP BY n.scheme_code, h""",
    "trail": """SELECT e.scheme_code,
        max(CASE WHEN h = '3m' THEN (e / st.s - 1) * 100 END) AS return_3m_pct,
        max(CASE WHEN h = '6m' THEN (e / st.s - 1) * 100 END) AS return_6m_pct,
        max(CASE WHEN h = '1y' THEN (pow(e / st.s, 365.25 / (end_date - d)) - 1) * 100 END) AS return_1y_pct,
        max(CASE WHEN h = '3y' THEN (pow(e / st.s, 365.25 / (end_date - d)) - 1) * 100 END) AS cagr_3y_pct,
        max(CASE WHEN h = '5y' THEN (pow(e / st.s, 365.25 / (end_date - d)) - 1) * 100 END) AS cagr_5y_pct
        FROM ends e LEFT JOIN starts st USING (scheme_code) GROUP BY e.scheme_code""",
    "since": """SELECT scheme_code, CASE WHEN n >= 2 AND (end_date - first_date) / 365.25 >= 1.0 / 12
        THEN (pow(e / s, 365.25 / (end_date - first_date)) - 1) * 100 END AS since_inception_cagr_pct FROM ends""",
    "moments": f"""SELECT scheme_code, count(*) AS n, stddev_samp(r) AS sd, avg(r) AS m,
        sqrt(avg(pow(least(r - {RD}, 0), 2))) AS dn, avg(CASE WHEN r >= 0 THEN 1.0 ELSE 0.0 END) * 100 AS pos
        FROM ret GROUP BY scheme_code""",
    "risk": f"""SELECT scheme_code,
        CASE WHEN n >= 20 THEN sd * sqrt(252) * 100 END AS volatility_pct,
        CASE WHEN n >= 20 THEN dn * sqrt(252) * 100 END AS downside_deviation_pct,
        CASE WHEN n >= 20 AND sd > 0 THEN (m - {RD}) / sd * sqrt(252) END AS sharpe_ratio,
        CASE WHEN n >= 20 AND dn > 0 THEN (m - {RD}) * 252 * 100 / (dn * sqrt(252) * 100) END AS sortino_ratio,
        pos AS positive_days_pct FROM moments""",
    "quant": """SELECT scheme_code, quantile_cont(r, 0.05) AS q, count(*) AS n FROM ret GROUP BY scheme_code HAVING n >= 20""",
    "tails": """SELECT scheme_code, abs(any_value(q)) * 100 AS var_95_pct, abs(avg(r) FILTER (r <= q)) * 100 AS cvar_95_pct
        FROM ret JOIN quant USING (scheme_code) GROUP BY scheme_code""",
    "dd": """SELECT scheme_code, date, nav, max(nav) OVER (PARTITION BY scheme_code ORDER BY date) AS pk FROM nav""",
    "low": """SELECT scheme_code, arg_min(date, (nav / pk - 1, date)) AS t, arg_min(pk, (nav / pk - 1, date)) AS p,
        min(nav / pk - 1) AS depth, max(date) AS last FROM dd GROUP BY scheme_code HAVING count(*) >= 2""",
    "mdd": """SELECT scheme_code, depth * 100 AS max_drawdown_pct,
        CASE WHEN depth < 0 THEN peak END AS max_drawdown_peak, CASE WHEN depth < 0 THEN t END AS max_drawdown_trough,
        CASE WHEN depth < 0 THEN back END AS max_drawdown_recovery,
        CASE WHEN depth < 0 THEN coalesce(back, last) - peak ELSE 0 END AS max_drawdown_days,
        CASE WHEN depth < 0 THEN back IS NOT NULL ELSE true END AS max_drawdown_recovered
        FROM (SELECT scheme_code, any_value(depth) AS depth, any_value(t) AS t, any_value(last) AS last,
          min(date) FILTER (nav = p AND date <= t) AS peak, min(date) FILTER (nav >= p AND date >= t) AS back
          FROM dd JOIN low USING (scheme_code) GROUP BY scheme_code)""",
    "curdd": "SELECT scheme_code, (e / top - 1) * 100 AS current_drawdown_pct FROM ends",
    "rollw": """SELECT a.scheme_code, a.date, (pow(a.nav / b.nav, 365.25 / (a.date - b.date)) - 1) * 100 AS a
        FROM nav a ASOF JOIN nav b ON a.scheme_code = b.scheme_code AND a.date - 1096 >= b.date
        WHERE a.date - b.date >= 0.9 * 1096""",
    "roll": """SELECT scheme_code, count(*) AS rolling_3y_observations, min(a) AS rolling_3y_min_pct,
        median(a) AS rolling_3y_median_pct, max(a) AS rolling_3y_max_pct,
        avg(CASE WHEN a > 0 THEN 1.0 ELSE 0.0 END) * 100 AS rolling_3y_positive_share_pct,
        avg(CASE WHEN a > 6.5 THEN 1.0 ELSE 0.0 END) * 100 AS rolling_3y_beat_hurdle_pct
        FROM rollw GROUP BY scheme_code HAVING count(*) >= 5""",
    "smas": """SELECT scheme_code, date, nav,
        CASE WHEN row_number() OVER w >= 50 THEN avg(nav) OVER (w ROWS 49 PRECEDING) END AS sma_50,
        CASE WHEN row_number() OVER w >= 200 THEN avg(nav) OVER (w ROWS 199 PRECEDING) END AS sma_200
        FROM nav WINDOW w AS (PARTITION BY scheme_code ORDER BY date)""",
    "signal": """SELECT scheme_code, nav AS latest_nav, sma_50, sma_200,
        CASE WHEN sma_50 IS NULL THEN 'INSUFFICIENT_HISTORY' WHEN nav >= sma_50 THEN 'BULLISH' ELSE 'BEARISH' END AS sma_signal,
        (nav / sma_50 - 1) * 100 AS nav_vs_sma50_pct
        FROM smas QUALIFY row_number() OVER (PARTITION BY scheme_code ORDER BY date DESC) = 1""",
    "al": f"""SELECT f.scheme_code, f.date, f.nav, b.nav AS bnav FROM nav f JOIN nav b ON f.date = b.date
        AND b.scheme_code = '{BENCHMARK}' AND f.scheme_code <> '{BENCHMARK}'""",
    "alr": """SELECT * FROM (SELECT scheme_code, nav / lag(nav) OVER w - 1 AS f, bnav / lag(bnav) OVER w - 1 AS b
        FROM al WINDOW w AS (PARTITION BY scheme_code ORDER BY date)) WHERE f IS NOT NULL""",
    "reg": f"""SELECT scheme_code, n AS overlap_days, beta,
        (pow(1 + (mf - {RD}) - beta * (mb - {RD}), 252) - 1) * 100 AS alpha_pct,
        CASE WHEN beta IS NOT NULL THEN c * c END AS r_squared, CASE WHEN beta IS NOT NULL THEN c END AS correlation,
        CASE WHEN beta IS NOT NULL THEN te END AS tracking_error_pct,
        CASE WHEN beta IS NOT NULL AND te > 0 THEN act * 25200 / te END AS information_ratio
        FROM (SELECT scheme_code, count(*) AS n, avg(f) AS mf, avg(b) AS mb, corr(f, b) AS c, avg(f - b) AS act,
          CASE WHEN count(*) >= 60 AND var_samp(b) > 0 THEN covar_samp(f, b) / var_samp(b) END AS beta,
          stddev_samp(f - b) * sqrt(252) * 100 AS te FROM alr GROUP BY scheme_code)""",
    "capm": """SELECT scheme_code, nav / lag(nav) OVER w - 1 AS f, bnav / lag(bnav) OVER w - 1 AS b
        FROM (SELECT scheme_code, date_trunc('month', date) AS month, arg_max(nav, date) AS nav, arg_max(bnav, date) AS bnav
          FROM al GROUP BY ALL) WINDOW w AS (PARTITION BY scheme_code ORDER BY month)""",
    "capt": """SELECT scheme_code,
        CASE WHEN count(*) FILTER (b > 0) >= 3 THEN (product(1 + f) FILTER (b > 0) - 1) / (product(1 + b) FILTER (b > 0) - 1) * 100 END AS up_capture_pct,
        CASE WHEN count(*) FILTER (b < 0) >= 3 THEN (product(1 + f) FILTER (b < 0) - 1) / (product(1 + b) FILTER (b < 0) - 1) * 100 END AS down_capture_pct
        FROM capm WHERE f IS NOT NULL GROUP BY scheme_code""",
    "exc": """SELECT scheme_code, (pow(e / s, 365.25 / (l - d)) - pow(be / bs, 365.25 / (l - d))) * 100 AS excess_return_1y_pct
        FROM (SELECT scheme_code, l, arg_max(nav, date) AS e, arg_max(bnav, date) AS be,
          max(date) FILTER (date <= l - 365) AS d, arg_max(nav, date) FILTER (date <= l - 365) AS s,
          arg_max(bnav, date) FILTER (date <= l - 365) AS bs
          FROM (SELECT *, max(date) OVER (PARTITION BY scheme_code) AS l FROM al) GROUP BY scheme_code, l)""",
    "inst": """SELECT * FROM (SELECT *, (year(date) * 12 + month(date)) - (year(lo) * 12 + month(lo)) AS k FROM (
          SELECT *, greatest(coalesce(date_trunc('month', prev), before), before) AS lo FROM (
            SELECT scheme_code, date, nav, lag(date) OVER (PARTITION BY scheme_code ORDER BY date) AS prev,
              min(date) OVER p AS first, max(date) OVER p AS last, count(*) OVER p AS obs,
              CAST(date_trunc('month', max(date) OVER p - 1096) - INTERVAL 1 MONTH AS DATE) AS before
            FROM nav WINDOW p AS (PARTITION BY scheme_code))))
        WHERE first <= last - 1096 AND obs >= 20 AND k > 0 AND date < last""",
    "units": """SELECT scheme_code, CAST(sum(k) AS BIGINT) AS instalments, sum(k * 10000.0 / nav) AS units, min(date) AS t0,
        any_value(last) AS last FROM inst GROUP BY scheme_code""",
    "flows": """SELECT scheme_code, list(y) AS ys, list(a) AS amounts FROM (
        SELECT i.scheme_code, (i.date - t0) / 365.0 AS y, -10000.0 * k AS a FROM inst i JOIN units USING (scheme_code)
        UNION ALL SELECT scheme_code, (last - t0) / 365.0, units * e FROM units JOIN ends USING (scheme_code)) GROUP BY scheme_code""",
    "bis": """SELECT scheme_code, 0 AS step, -0.9999::DOUBLE AS lo, 1000.0::DOUBLE AS hi, ys, amounts,
          sign(list_sum(list_transform(list_zip(ys, amounts), lambda x: x[2] * pow(1 + -0.9999, -x[1])))) AS s,
          sign(list_sum(list_transform(list_zip(ys, amounts), lambda x: x[2] * pow(1 + 1000.0, -x[1])))) AS t
        FROM flows
        UNION ALL SELECT scheme_code, step + 1, CASE WHEN sm = s THEN mid ELSE lo END, CASE WHEN sm = s THEN hi ELSE mid END, ys, amounts, s, t
        FROM (SELECT *, (lo + hi) / 2 AS mid,
            sign(list_sum(list_transform(list_zip(ys, amounts), lambda x: x[2] * pow(1 + (lo + hi) / 2, -x[1])))) AS sm
          FROM bis WHERE step < 60)""",
    "xirr": """SELECT scheme_code, CASE WHEN s * t < 0 THEN (lo + hi) / 2 * 100 END AS sip_xirr_3y_pct FROM bis WHERE step = 60""",
    "full": """SELECT n.*, calmar.calmar_ratio FROM (SELECT scheme_code, n AS observations, first_date, end_date AS as_of,
          round((end_date - first_date) / 365.25, 6) AS history_years,
          CASE WHEN CAST(scheme_code AS INT) % 7 = 0 THEN 'synthetic' ELSE 'amfi' END AS data_source,
          trail.* EXCLUDE (scheme_code), since.* EXCLUDE (scheme_code), risk.* EXCLUDE (scheme_code),
          tails.* EXCLUDE (scheme_code), mdd.* EXCLUDE (scheme_code), curdd.* EXCLUDE (scheme_code),
          roll.* EXCLUDE (scheme_code), signal.* EXCLUDE (scheme_code), xirr.* EXCLUDE (scheme_code)
        FROM ends LEFT JOIN trail USING (scheme_code) LEFT JOIN since USING (scheme_code) LEFT JOIN risk USING (scheme_code)
          LEFT JOIN tails USING (scheme_code) LEFT JOIN mdd USING (scheme_code) LEFT JOIN curdd USING (scheme_code)
          LEFT JOIN roll USING (scheme_code) LEFT JOIN signal USING (scheme_code) LEFT JOIN xirr USING (scheme_code)) n
        LEFT JOIN (SELECT scheme_code, CASE WHEN max_drawdown_pct <> 0 THEN cagr_3y_pct / abs(max_drawdown_pct) END AS calmar_ratio
          FROM trail JOIN mdd USING (scheme_code)) calmar USING (scheme_code)""",
    "peer": """SELECT scheme_code, scheme_name, fund_house, scheme_category, observations, round_even(history_years, 1) AS history_years,
        round_even(return_1y_pct, 2) AS return_1y_pct, round_even(cagr_3y_pct, 2) AS cagr_3y_pct,
        round_even(cagr_5y_pct, 2) AS cagr_5y_pct, round_even(sharpe_ratio, 2) AS sharpe_ratio,
        round_even(sortino_ratio, 2) AS sortino_ratio, round_even(calmar_ratio, 2) AS calmar_ratio,
        round_even(volatility_pct, 2) AS volatility_pct, round_even(max_drawdown_pct, 2) AS max_drawdown_pct,
        round_even(sip_xirr_3y_pct, 2) AS sip_xirr_3y_pct
        FROM full_ JOIN info USING (scheme_code) WHERE observations >= 30
        QUALIFY row_number() OVER (PARTITION BY scheme_category ORDER BY observations DESC, scheme_code) <= 400""",
    "long": """SELECT scheme_code, scheme_category, metric, value, metric <> 'volatility_pct' AS higher_is_better,
        CASE WHEN metric = 'volatility_pct' THEN -value ELSE value END AS v FROM (UNPIVOT (SELECT scheme_code, scheme_category,
          return_1y_pct, cagr_3y_pct, cagr_5y_pct, sharpe_ratio, sortino_ratio, calmar_ratio, volatility_pct,
          max_drawdown_pct, sip_xirr_3y_pct FROM peer)
        ON COLUMNS(* EXCLUDE (scheme_code, scheme_category)) INTO NAME metric VALUE value)""",
    "ranked": """SELECT *, least(4, CAST(floor((100 - percentile) / 25) AS INT) + 1) AS quartile FROM (
        SELECT scheme_code, scheme_category, metric, value, higher_is_better, count(*) OVER g AS peers,
          (rank() OVER u - 1 + count(*) OVER (u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0 / count(*) OVER g * 100 AS percentile,
          rank() OVER (PARTITION BY scheme_category, metric ORDER BY v DESC) AS rank,
          median(value) OVER g AS category_median
        FROM long WINDOW g AS (PARTITION BY scheme_category, metric), u AS (PARTITION BY scheme_category, metric ORDER BY v))
        WHERE peers >= 5""",
    "comps": """SELECT p.scheme_code, any_value(p.n) AS n,
        avg(percentile) FILTER (metric IN ('return_1y_pct', 'cagr_3y_pct', 'cagr_5y_pct')) AS score_returns,
        avg(percentile) FILTER (metric IN ('sharpe_ratio', 'sortino_ratio', 'calmar_ratio')) AS score_risk_adjusted,
        avg(percentile) FILTER (metric IN ('max_drawdown_pct', 'volatility_pct')) AS score_drawdown,
        avg(percentile) FILTER (metric = 'sip_xirr_3y_pct') AS score_consistency
        FROM (SELECT scheme_code, count(*) OVER (PARTITION BY scheme_category) AS n FROM peer) p
        LEFT JOIN ranked ON ranked.scheme_code = p.scheme_code AND p.n >= 5 GROUP BY p.scheme_code""",
    "scored": """SELECT peer.*, n, score_returns, score_risk_adjusted, score_drawdown, score_consistency,
        round_even(round((coalesce(score_returns * 0.35, 0) + coalesce(score_risk_adjusted * 0.35, 0) + coalesce(score_drawdown * 0.2, 0)
          + coalesce(score_consistency * 0.1, 0)) / nullif(w, 0), 9), 1) AS score, k AS score_components
        FROM peer JOIN (SELECT *, CASE WHEN score_returns IS NOT NULL THEN 0.35 ELSE 0 END + CASE WHEN score_risk_adjusted IS NOT NULL THEN 0.35 ELSE 0 END
            + CASE WHEN score_drawdown IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN score_consistency IS NOT NULL THEN 0.1 ELSE 0 END AS w,
          CAST(score_returns IS NOT NULL AS INT) + CAST(score_risk_adjusted IS NOT NULL AS INT) + CAST(score_drawdown IS NOT NULL AS INT)
            + CAST(score_consistency IS NOT NULL AS INT) AS k FROM comps) USING (scheme_code)""",
    "enav": """SELECT * FROM (SELECT CAST(user_id AS VARCHAR) AS scheme_code, CAST(ts AS DATE) AS date, round(avg(value), 4) AS nav
        FROM events GROUP BY ALL) WHERE nav > 0""",
    "raw": """SELECT 'l' || scheme_code AS scheme_code, date, nav, CASE WHEN CAST(scheme_code AS INT) % 7 = 0 THEN 'synthetic' ELSE 'amfi' END AS data_source,
        scheme_name FROM lines LEFT JOIN info USING (scheme_code)
        UNION ALL SELECT scheme_code, date, nav, data_source, CASE WHEN CAST(scheme_code AS INT) % 10 = 4 THEN 'Unknown scheme ' || scheme_code ELSE scheme_name END
        FROM nav LEFT JOIN info USING (scheme_code)
        UNION ALL SELECT 'e' || scheme_code, date, nav, 'amfi', 'Events ' || scheme_code FROM enav""",
    "ing": """SELECT scheme_code, any_value(scheme_name) AS scheme_name, any_value(data_source) AS data_source, count(*) AS observations,
        min(date) AS first_date, max(date) AS last_date, count(*) FILTER (nav IS NULL OR nav <= 0) AS bad,
        count(*) - count(DISTINCT date) AS dup, count(*) FILTER (date > DATE '2001-11-05') AS fut,
        count(*) FILTER (mv > 20) AS ext, max(mv) AS worst, count(*) FILTER (gap > 5) AS gaps,
        DATE '2001-11-05' - max(date) AS stale, (max(date) - min(date)) / 365.25 AS years
        FROM (SELECT *, abs(nav / lag(nav) OVER w - 1) * 100 AS mv,
          (SELECT count(*) FROM range(0, 0)) + len(list_filter(generate_series(lag(date) OVER w, date, INTERVAL 1 DAY), lambda d: isodow(d) < 6)) - 2 AS gap
          FROM raw WINDOW w AS (PARTITION BY scheme_code ORDER BY date, nav)) GROUP BY scheme_code""",
    "fnd": """SELECT scheme_code, f.severity AS severity, f."check" AS "check", CAST(f.n AS BIGINT) AS affected_rows FROM (
        SELECT scheme_code, unnest([
          CASE WHEN bad > 0 THEN {'severity': 'CRITICAL', 'check': 'non_positive_nav', 'n': bad} END,
          CASE WHEN dup > 0 THEN {'severity': 'CRITICAL', 'check': 'duplicate_dates', 'n': dup} END,
          CASE WHEN fut > 0 THEN {'severity': 'CRITICAL', 'check': 'future_dated', 'n': fut} END,
          CASE WHEN observations < 30 THEN {'severity': 'CRITICAL', 'check': 'insufficient_history', 'n': observations} END,
          CASE WHEN stale > 7 THEN {'severity': 'WARNING', 'check': 'stale_data', 'n': 0} END,
          CASE WHEN ext > 0 THEN {'severity': 'WARNING', 'check': 'extreme_move', 'n': ext} END,
          CASE WHEN gaps > 0 THEN {'severity': 'WARNING', 'check': 'calendar_gap', 'n': gaps} END,
          CASE WHEN coalesce(scheme_name, '') = '' OR scheme_name LIKE 'Unknown scheme%' THEN {'severity': 'WARNING', 'check': 'missing_metadata', 'n': 0} END,
          CASE WHEN data_source = 'synthetic' THEN {'severity': 'WARNING', 'check': 'synthetic_data', 'n': 0} END,
          CASE WHEN years < 3 AND observations >= 30 THEN {'severity': 'INFO', 'check': 'short_history', 'n': 0} END]) AS f FROM ing)
        WHERE f IS NOT NULL""",
    "cov": """SELECT i.*, coalesce(c.observations, 0) AS observations, first_date, last_date, data_source FROM info i LEFT JOIN (
        SELECT scheme_code, count(*) AS observations, min(date) AS first_date, max(date) AS last_date, max(data_source) AS data_source
        FROM nav GROUP BY scheme_code) c USING (scheme_code)""",
    "ups": """SELECT coalesce(o.scheme_code, b.scheme_code) AS scheme_code, coalesce(o.date, b.date) AS date,
        CASE WHEN b.nav IS NOT NULL AND (o.nav IS NULL OR o.nav <> b.nav) THEN b.nav ELSE o.nav END AS nav,
        CASE WHEN b.nav IS NOT NULL AND (o.nav IS NULL OR o.nav <> b.nav) THEN 'feed' ELSE o.data_source END AS data_source,
        CASE WHEN o.nav IS NULL THEN 'inserted' WHEN b.nav IS NOT NULL AND o.nav <> b.nav THEN 'updated' END AS action
        FROM (SELECT * FROM nav WHERE date < DATE '2001-01-01') o FULL JOIN (SELECT * FROM clean WHERE date >= DATE '2000-07-01') b
          ON o.scheme_code = b.scheme_code AND o.date = b.date""",
}
_NAMES = {"full_": "full"}


def _sql(body: str) -> str:
    """The body after the common table expressions that it needs."""
    import re

    need: dict[str, None] = {}

    def visit(text: str, own: str = "") -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_]+\b", text)):
            key = _NAMES.get(word, word)
            used = re.search(rf"\b(?:FROM|JOIN|,)\s+\(?{word}\b(?!\s*\()", text)
            if key in CTES and key != own and used and word not in need:
                visit(CTES[key], key)
                need[word] = None

    visit(body)
    parts = [f"{n} AS ({CTES[_NAMES.get(n, n)]})" for n in need]
    return f"WITH RECURSIVE {', '.join(parts)}\n{body}" if parts else body


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _oracle[name] = _sql(sql)
        return f

    return register


def tidy(df: DataFrame, digits: int = 6, wide: bool = False) -> DataFrame:
    """Doubles rounded, for comparison; wide: those from 1e5 on to nine significant digits."""

    def shown(name: str) -> Column:
        c = F.round(name, digits) + 0.0
        return F.when(F.abs(name) >= 1e5, F.format_string("%.8e", name).cast("double")).otherwise(c) if wide else c

    return df.select(*[shown(f.name).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


def _rounded(table: str, columns: str, digits: int = 6, plain: str = "scheme_code", more: str = "") -> str:
    shown = "CASE WHEN abs({0}) >= 1e5 THEN CAST(printf('%.8e', {0}) AS DOUBLE) ELSE round({0}, {1}) + 0.0 END AS {0}"
    out = [plain] + [shown.format(c, digits) for c in columns.split()]
    return f"SELECT {', '.join(out)} FROM {table} {more}"


def _on(name: str, table: str, columns: str, f: Callable[[DataFrame], DataFrame], plain: str = "scheme_code", digits: int = 6) -> None:
    """Register an operator on the NAV panel."""
    wanted = [c.strip() for c in plain.split(",")] + columns.split()
    query(name, _rounded(table, columns, digits, plain))(lambda s, d: tidy(f(star_nav(s, d)).select(*wanted), digits, wide=True))


def _aligned(nav: DataFrame) -> DataFrame:
    return bm.align(nav, BENCHMARK)


_on("daily_returns", "ret", "nav r", returns.daily_returns, "scheme_code, date")
_on("sma_panel", "smas", "nav sma_50 sma_200", returns.moving_averages, "scheme_code, date", 7)
_on("sma_signal", "signal", "latest_nav sma_50 sma_200 nav_vs_sma50_pct", returns.sma_signal, "scheme_code, sma_signal", 7)
_on("trailing_returns", "trail", "return_3m_pct return_6m_pct return_1y_pct cagr_3y_pct cagr_5y_pct", returns.trailing_returns)
_on("since_inception_cagr", "since", "since_inception_cagr_pct", returns.since_inception)
_on("volatility", "risk", "volatility_pct", risk.return_moments)
_on("downside_deviation", "risk", "downside_deviation_pct", risk.return_moments)
_on("sharpe", "risk", "sharpe_ratio", risk.return_moments)
_on("sortino", "risk", "sortino_ratio", risk.return_moments)
_on("positive_days", "risk", "positive_days_pct", risk.return_moments)
_on("var_95", "tails", "var_95_pct", risk.tail_risk)
_on("cvar_95", "tails", "cvar_95_pct", risk.tail_risk)
_on("max_drawdown", "mdd", "max_drawdown_pct", risk.max_drawdown,
    "scheme_code, max_drawdown_peak, max_drawdown_trough, max_drawdown_recovery, max_drawdown_days, max_drawdown_recovered")
_on("current_drawdown", "curdd", "current_drawdown_pct", risk.current_drawdown)
_on("rolling_3y", "roll", "rolling_3y_min_pct rolling_3y_median_pct rolling_3y_max_pct rolling_3y_positive_share_pct rolling_3y_beat_hurdle_pct",
    rolling.rolling_stats, "scheme_code, rolling_3y_observations")
_on("benchmark_regression", "reg", "beta alpha_pct r_squared correlation tracking_error_pct information_ratio",
    lambda n: bm.regression(_aligned(n)), "scheme_code, overlap_days")
_on("capture_ratios", "capt", "up_capture_pct down_capture_pct", lambda n: bm.capture_ratios(_aligned(n)))
_on("excess_1y", "exc", "excess_return_1y_pct", lambda n: bm.excess_1y(_aligned(n)))
_on("sip_units", "units", "units", sip.sip_units, "scheme_code, instalments")
_on("sip_xirr", "xirr", "sip_xirr_3y_pct", sip.sip_xirr)


@query("drawdown_series", "SELECT scheme_code, date, nav, pk AS peak, round((nav / pk - 1) * 100, 6) AS drawdown_pct FROM dd")
def _(spark, sf_dir):
    return tidy(risk.drawdown_series(star_nav(spark, sf_dir)))


@query(
    "monthly_returns",
    """SELECT * FROM (SELECT scheme_code, month, nav, round(nav / lag(nav) OVER (PARTITION BY scheme_code ORDER BY month) - 1, 6) AS r
    FROM (SELECT scheme_code, CAST(date_trunc('month', date) AS DATE) AS month, arg_max(nav, date) AS nav FROM nav GROUP BY ALL))
    WHERE r IS NOT NULL""",
)
def _(spark, sf_dir):
    return tidy(returns.monthly_returns(star_nav(spark, sf_dir)))


@query(
    "growth_rebased",
    """SELECT scheme_code, date, round(nav / first_value(nav) OVER (PARTITION BY scheme_code ORDER BY date) * 10000, 4) AS growth
    FROM nav WHERE date >= (SELECT max(first_date) FROM ends)""",
)
def _(spark, sf_dir):
    return tidy(returns.growth(star_nav(spark, sf_dir)), 4)


@query(
    "calmar",
    """SELECT scheme_code, round(CASE WHEN max_drawdown_pct <> 0 THEN cagr_3y_pct / abs(max_drawdown_pct) END, 6) AS calmar_ratio
    FROM trail JOIN mdd USING (scheme_code)""",
)
def _(spark, sf_dir):
    nav = star_nav(spark, sf_dir)
    both = returns.trailing_returns(nav).join(risk.max_drawdown(nav), "scheme_code")
    return tidy(both.select("scheme_code", bundle.calmar().alias("calmar_ratio")))


@query(
    "panel_scan",
    """SELECT n.scheme_code, coalesce(i.scheme_name, 'Unknown scheme ' || n.scheme_code) AS scheme_name, fund_house, scheme_category,
    date, nav, data_source FROM nav n LEFT JOIN (SELECT * REPLACE (CASE WHEN CAST(scheme_code AS INT) % 9 = 0 THEN 'x' || scheme_code ELSE scheme_code END AS scheme_code) FROM info) i
    ON n.scheme_code = i.scheme_code""",
)
def _(spark, sf_dir):
    other = F.when(F.col("scheme_code").cast("int") % 9 == 0, F.concat(F.lit("x"), "scheme_code")).otherwise(F.col("scheme_code"))
    return load_panel(star_nav(spark, sf_dir), star_info(spark, sf_dir).withColumn("scheme_code", other))


@query("clean_series", "SELECT scheme_code, date, nav FROM clean")
def _(spark, sf_dir):
    return clean_series(star_lines(spark, sf_dir), "s1", "s2", "s3").select("scheme_code", "date", "nav")


@query(
    "catalogue_stats",
    """SELECT (SELECT count(DISTINCT scheme_code) FROM info) AS schemes, (SELECT count(DISTINCT scheme_category) FROM info) AS categories,
    (SELECT count(DISTINCT fund_house) FROM info) AS fund_houses, count(*) FILTER (n >= 30) AS analysable, CAST(sum(n) AS BIGINT) AS nav_rows FROM ends""",
)
def _(spark, sf_dir):
    return catalogue.statistics(star_info(spark, sf_dir), star_nav(spark, sf_dir))


@query("scheme_coverage", "SELECT scheme_code, scheme_name, fund_house, scheme_category, observations, first_date, last_date, data_source FROM cov")
def _(spark, sf_dir):
    return catalogue.scheme_coverage(star_info(spark, sf_dir), star_nav(spark, sf_dir))


@query(
    "category_coverage_top15",
    """SELECT scheme_category, count(DISTINCT scheme_code) AS schemes, CAST(sum(CASE WHEN observations >= 500 OR observations >= 30 THEN 1 ELSE 0 END) AS BIGINT) AS analysable
    FROM cov GROUP BY scheme_category ORDER BY schemes DESC, scheme_category LIMIT 15""",
)
def _(spark, sf_dir):
    return catalogue.category_coverage(star_info(spark, sf_dir), star_nav(spark, sf_dir))


@query("categories", "SELECT DISTINCT scheme_category FROM info WHERE scheme_category IS NOT NULL")
def _(spark, sf_dir):
    return catalogue.categories(star_info(spark, sf_dir))


@query(
    "backfill_queue",
    """SELECT scheme_code, scheme_type, observations, CASE WHEN scheme_type LIKE 'Open Ended%' THEN 0 WHEN scheme_type LIKE 'Interval%' THEN 1 ELSE 2 END AS priority
    FROM (SELECT CAST(u AS VARCHAR) AS scheme_code, CASE u % 3 WHEN 0 THEN 'Open Ended Schemes' WHEN 1 THEN 'Interval Fund' ELSE 'Close Ended' END AS scheme_type
      FROM (SELECT DISTINCT user_id AS u FROM events))
    LEFT JOIN (SELECT scheme_code, count(*) AS observations FROM enav GROUP BY ALL) USING (scheme_code) WHERE observations < 30
    ORDER BY priority, observations DESC, scheme_code LIMIT 100""",
)
def _(spark, sf_dir):
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("u")).distinct()
    kind = F.when(F.col("u") % 3 == 0, "Open Ended Schemes").when(F.col("u") % 3 == 1, "Interval Fund").otherwise("Close Ended")
    info = users.select(F.col("u").cast("string").alias("scheme_code"), kind.alias("scheme_type"))
    return catalogue.backfill_queue(info, event_nav(spark, sf_dir))


@query(
    "search_schemes",
    """SELECT scheme_code, scheme_name, fund_house, scheme_category, observations, last_date FROM cov
    WHERE scheme_name ILIKE '%supplier%1%' AND scheme_category = 'ASIA' AND observations >= 30 ORDER BY observations DESC, scheme_name, scheme_code LIMIT 200""",
)
def _(spark, sf_dir):
    return catalogue.search(star_info(spark, sf_dir), star_nav(spark, sf_dir), query="supplier%1", category="ASIA", with_history_only=True)


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = star_nav(spark, sf_dir).where("date < date'2001-01-01'")
    return merge.merge_nav(old, star_lines(spark, sf_dir).where("date >= date'2000-07-01'"), "feed", "s1", "s2", "s3")


@query("nav_upsert_merge", "SELECT scheme_code, date, nav, data_source, action FROM ups")
def _(spark, sf_dir):
    return _upserted(spark, sf_dir)


@query("nav_upsert_counts", "SELECT count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'updated') AS updated FROM ups")
def _(spark, sf_dir):
    return merge.merge_counts(_upserted(spark, sf_dir))


@query(
    "store_upsert",
    """SELECT scheme_code, date, nav, data_source, (SELECT count(*) FROM ups WHERE action = 'inserted') AS inserted,
    (SELECT count(*) FROM ups WHERE action = 'updated') AS updated FROM ups""",
)
def _(spark, sf_dir):
    """The same upsert through a store: partitions by month, commits, and counts observed in the write."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", buckets=2)
    store.upsert_nav(star_nav(spark, sf_dir).where("date < date'2001-01-01' and data_source = 'amfi'"), "amfi")
    store.upsert_nav(star_nav(spark, sf_dir).where("date < date'2001-01-01' and data_source = 'synthetic'"), "synthetic")
    got = store.upsert_nav(star_lines(spark, sf_dir).where("date >= date'2000-07-01'"), "feed", "s1", "s2", "s3")
    rows = store.table("nav_history").select("scheme_code", "date", "nav", "data_source")
    return rows.withColumns({"inserted": F.lit(got.inserted).cast("long"), "updated": F.lit(got.updated).cast("long")})


@query("without_empty_columns", _rounded("full_", "sharpe_ratio max_drawdown_pct"))
def _(spark, sf_dir):
    rows = settled(_metrics(spark, sf_dir).select("scheme_code", "sharpe_ratio", "max_drawdown_pct", *bundle.BENCHMARK_COLUMNS))
    return tidy(screener.without_empty(rows))


@query("ranked_by", _rounded("full_", "sharpe_ratio") + " WHERE sharpe_ratio IS NOT NULL")
def _(spark, sf_dir):
    rows = _metrics(spark, sf_dir).select("scheme_code", "sharpe_ratio")
    return tidy(Analysis(rows, rows, rows, DEFAULT).ranked_by("sharpe_ratio"))


@query(
    "dimension_upsert",
    """SELECT coalesce(o.scheme_code, n.scheme_code) AS scheme_code, coalesce(n.fund_house, o.fund_house) AS fund_house,
    coalesce(n.scheme_category, o.scheme_category) AS scheme_category, CASE WHEN n.scheme_code IS NOT NULL THEN n.scheme_name ELSE o.scheme_name END AS scheme_name
    FROM info o FULL JOIN (
      SELECT CASE WHEN CAST(scheme_code AS INT) % 4 = 0 THEN 'n' ELSE '' END || scheme_code AS scheme_code, 'New ' || scheme_name AS scheme_name,
        CASE WHEN CAST(scheme_code AS INT) % 3 <> 0 THEN fund_house END AS fund_house,
        CAST(NULL AS VARCHAR) AS scheme_category FROM info) n ON o.scheme_code = n.scheme_code""",
)
def _(spark, sf_dir):
    info, k = star_info(spark, sf_dir), F.col("scheme_code").cast("int")
    code = F.concat(F.when(k % 4 == 0, "n").otherwise(""), "scheme_code")
    new = info.select(
        code.alias("scheme_code"), F.concat(F.lit("New "), "scheme_name").alias("scheme_name"),
        F.when(k % 3 != 0, F.col("fund_house")).alias("fund_house"), F.lit(None).cast("string").alias("scheme_category"),
    )
    return merge.merge_info(info, new, ["fund_house", "scheme_category"], ["scheme_name"])


@query("mirror_slice", "SELECT scheme_code, date, nav, data_source FROM nav WHERE date >= DATE '2001-11-05' - 1826")
def _(spark, sf_dir):
    return merge.mirror_slice(star_nav(spark, sf_dir), TODAY)


@query(
    "mirror_check",
    """SELECT count(*) AS rows, count(DISTINCT scheme_code) AS schemes, min(date) AS first_date, max(date) AS last_date
    FROM nav WHERE date >= DATE '2001-11-05' - 1826""",
)
def _(spark, sf_dir):
    return merge.mirror_check(merge.mirror_slice(star_nav(spark, sf_dir), TODAY))


@query(
    "mirror_push",
    """SELECT coalesce(s.scheme_code, m.scheme_code) AS scheme_code, coalesce(s.date, m.date) AS date, coalesce(s.nav, m.nav) AS nav,
    coalesce(s.data_source, m.data_source) AS data_source, CASE WHEN m.nav IS NULL THEN 'inserted' WHEN s.nav IS NOT NULL THEN 'updated' END AS action
    FROM (SELECT * FROM nav WHERE date >= DATE '2001-11-05' - 1826) s
    FULL JOIN (SELECT scheme_code, date, nav * 2 AS nav, 'mirror' AS data_source FROM nav WHERE date < DATE '1998-06-01') m
    ON s.scheme_code = m.scheme_code AND s.date = m.date""",
)
def _(spark, sf_dir):
    nav = star_nav(spark, sf_dir)
    mirror = nav.where("date < date'1998-06-01'").withColumns({"nav": F.col("nav") * 2, "data_source": F.lit("mirror")})
    return merge.push_nav(mirror, merge.mirror_slice(nav, TODAY))


@query(
    "recent_runs",
    """SELECT run_id, seq, status, rows_written, "at", started_at FROM (
      SELECT CAST(l_orderkey AS VARCHAR) AS run_id, l_linenumber AS seq, l_linestatus AS status, CAST(floor(l_quantity) AS BIGINT) AS rows_written,
        date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS "at",
        min(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) OVER (PARTITION BY l_orderkey) AS started_at,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_shipdate DESC) AS n FROM lineitem)
    WHERE n = 1 ORDER BY started_at DESC, run_id DESC LIMIT 10""",
)
def _(spark, sf_dir):
    # an order is a run: its lines are its events, numbered from the first, and written in no order of time
    events = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_linenumber").alias("seq"), F.col("l_linestatus").alias("status"),
        F.floor("l_quantity").cast("long").alias("rows_written"), F.unix_date(F.col("l_shipdate").cast("date")).cast("long").alias("at"),
    )
    return merge.latest_runs(events)


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle.scheme_metrics(star_nav(spark, sf_dir))


FULL = (
    "latest_nav return_3m_pct return_6m_pct return_1y_pct cagr_3y_pct cagr_5y_pct since_inception_cagr_pct volatility_pct downside_deviation_pct sharpe_ratio "
    "sortino_ratio positive_days_pct var_95_pct cvar_95_pct max_drawdown_pct current_drawdown_pct calmar_ratio rolling_3y_min_pct rolling_3y_median_pct "
    "rolling_3y_max_pct nav_vs_sma50_pct sip_xirr_3y_pct history_years"
)
FULL_PLAIN = "scheme_code, observations, first_date, as_of, data_source, max_drawdown_peak, max_drawdown_trough, max_drawdown_days, sma_signal"


@query("scheme_metrics_full", _rounded("full_", FULL, 6, FULL_PLAIN))
def _(spark, sf_dir):
    return tidy(_metrics(spark, sf_dir).select(*FULL_PLAIN.split(", "), *FULL.split()), wide=True)


@query(
    "scheme_metrics_benchmark",
    _rounded(
        "(SELECT scheme_code, full_.observations, reg.* EXCLUDE (scheme_code), capt.* EXCLUDE (scheme_code), exc.* EXCLUDE (scheme_code) FROM full_ "
        "LEFT JOIN reg USING (scheme_code) LEFT JOIN capt USING (scheme_code) LEFT JOIN exc USING (scheme_code))",
        " ".join(c for c in bundle.BENCHMARK_COLUMNS if c != "overlap_days"), 6, "scheme_code, observations, overlap_days",
    ),
)
def _(spark, sf_dir):
    rows = bundle.scheme_metrics(star_nav(spark, sf_dir), BENCHMARK)
    return tidy(rows.select("scheme_code", "observations", *bundle.BENCHMARK_COLUMNS), wide=True)


@query(
    "metric_notes",
    """SELECT scheme_code, concat_ws('; ',
      CASE WHEN history_years < 3 THEN 'Only ' || printf('%.1f', history_years) || ' years of history: 3Y and 5Y figures are missing' END,
      CASE WHEN data_source = 'synthetic' THEN 'SYNTHETIC data: not investable' END) AS notes FROM full_""",
)
def _(spark, sf_dir):
    return _metrics(spark, sf_dir).select("scheme_code", F.array_join("notes", "; ").alias("notes"))


@query(
    "metric_means",
    """SELECT round(avg(sharpe_ratio), 6) AS sharpe_ratio, round(avg(volatility_pct), 6) AS volatility_pct, round(avg(max_drawdown_pct), 6) AS max_drawdown_pct
    FROM full_""",
)
def _(spark, sf_dir):
    return tidy(risk.means(_metrics(spark, sf_dir), ["sharpe_ratio", "volatility_pct", "max_drawdown_pct"]))


@query(
    "series_decimated",
    """SELECT scheme_code, date, nav FROM (SELECT *, row_number() OVER (PARTITION BY scheme_code ORDER BY date) AS i, count(*) OVER (PARTITION BY scheme_code) AS n FROM nav)
    WHERE (i - 1) % greatest(1, n // 100) = 0 OR i = n""",
)
def _(spark, sf_dir):
    return returns.decimate(star_nav(spark, sf_dir), 100).select("scheme_code", "date", "nav")


@query(
    "history_payloads",
    "SELECT scheme_code, date, nav FROM nav",
)
def _(spark, sf_dir):
    """Each scheme's series written as a JSON payload, and parsed back."""
    point = F.struct(F.date_format("date", "dd-MM-yyyy").alias("date"), F.format_string("%.4f", "nav").alias("nav"))
    series = star_nav(spark, sf_dir).groupBy("scheme_code").agg(F.collect_list(point).alias("data"))
    return history.parse(series.select("scheme_code", F.to_json(F.struct("data")).alias("payload"))).drop("seq")


@query(
    "catalogue_feed",
    """SELECT scheme_code, scheme_name, fund_house, 'Open Ended' AS scheme_type, scheme_category, nav, end_date AS nav_date FROM info
    LEFT JOIN (SELECT scheme_code, end_date, e AS nav FROM ends) USING (scheme_code)""",
)
def _(spark, sf_dir):
    """The dimension and its latest NAVs written as the lines of a feed, a file a category, and parsed back."""
    last = star_nav(spark, sf_dir).groupBy("scheme_code").agg(F.max("date").alias("d"), F.max_by("nav", "date").alias("v"))
    rows = star_info(spark, sf_dir).join(last, "scheme_code", "left")
    value = F.coalesce(F.format_string("%.4f", "v"), F.lit("N.A."))
    line = F.concat_ws(";", "scheme_code", F.lit("-"), F.lit("-"), "scheme_name", value, F.coalesce(F.date_format("d", "dd-MMM-yyyy"), F.lit("-")))
    houses = rows.groupBy("scheme_category", "fund_house").agg(F.concat(F.array("fund_house"), F.array_sort(F.collect_list(line))).alias("lines"))
    head = F.format_string("Open Ended Schemes(%s)", "scheme_category")
    files = houses.groupBy("scheme_category").agg(F.flatten(F.array_sort(F.collect_list("lines"))).alias("lines"))
    lines = files.select(F.col("scheme_category").alias("file"), F.posexplode(F.concat(F.array(head), "lines")).alias("n", "line"))
    return navall.parse(lines)[0].drop("isin_growth", "isin_reinvest")


def _peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rounded rows of each category's deepest schemes."""
    columns = ["scheme_code", "observations", "history_years", *peers.RANKED_METRICS]
    # the ranks read the rows several times: work them out once
    rows = settled(bundle.rounded(_metrics(spark, sf_dir).select(*columns)).join(star_info(spark, sf_dir), "scheme_code"))
    return peers.peer_universe(rows, rows.select("scheme_code", F.col("observations").alias("raw_rows")))


@query(
    "peer_ranks",
    """SELECT scheme_code, scheme_category, metric, value, round(percentile, 6) AS percentile, rank, peers, round(category_median, 6) AS category_median,
    higher_is_better, quartile FROM ranked""",
)
def _(spark, sf_dir):
    return tidy(peers.peer_ranks(_peers(spark, sf_dir)))


@query(
    "category_summary",
    """SELECT scheme_category, metric, round_even(round(median(value), 6), 2) AS median,
    round_even(CASE WHEN metric = 'volatility_pct' THEN min(value) ELSE max(value) END, 2) AS best, count(value) AS schemes FROM long GROUP BY scheme_category, metric""",
)
def _(spark, sf_dir):
    return peers.category_summary(_peers(spark, sf_dir))


@query(
    "peer_comparison",
    """SELECT scheme_code, max(peers) AS peers, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (quartile = 1), '') AS top_quartile,
    coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (quartile = 4), '') AS bottom_quartile,
    round(max(percentile) FILTER (metric = 'sharpe_ratio'), 1) AS pct_sharpe_ratio FROM ranked GROUP BY scheme_code""",
)
def _(spark, sf_dir):
    wide = peers.comparisons(peers.peer_ranks(_peers(spark, sf_dir)))
    told = [F.array_join(c, ",").alias(c) for c in ("top_quartile", "bottom_quartile")]
    return wide.select("scheme_code", "peers", *told, "pct_sharpe_ratio")


SCORE = ["score_returns", "score_risk_adjusted", "score_drawdown", "score_consistency"]


@query("composite_score", _rounded("scored", " ".join(SCORE), 6, "scheme_code, scheme_category, score, score_components"))
def _(spark, sf_dir):
    scored = peers.composite_scores(_peers(spark, sf_dir))
    return tidy(scored.select("scheme_code", "scheme_category", "score", "score_components", *SCORE))


@query(
    "score_explain",
    """SELECT scheme_code, score, n AS peers, component, round(value, 6) AS value, round(CASE WHEN value IS NOT NULL THEN w / total END, 6) AS weight,
    round(w / total * value, 6) AS contribution FROM (
      SELECT scheme_code, score, n, x.component AS component, x.value AS value, x.w AS w, sum(CASE WHEN x.value IS NOT NULL THEN x.w END) OVER (PARTITION BY scheme_code) AS total
      FROM (SELECT scheme_code, score, n, unnest([{'component': 'returns', 'value': score_returns, 'w': 0.35}, {'component': 'risk_adjusted', 'value': score_risk_adjusted, 'w': 0.35},
        {'component': 'drawdown', 'value': score_drawdown, 'w': 0.2}, {'component': 'consistency', 'value': score_consistency, 'w': 0.1}]) AS x FROM scored))""",
)
def _(spark, sf_dir):
    return tidy(peers.explain_scores(peers.composite_scores(_peers(spark, sf_dir))))


@query(
    "screen",
    """SELECT scheme_code, scheme_category, fund_house, score, volatility_pct, max_drawdown_pct FROM scored
    WHERE regexp_matches(fund_house, '(?i)a') AND max_drawdown_pct <= -50 AND observations >= 500 ORDER BY score DESC NULLS LAST, scheme_code LIMIT 50""",
)
def _(spark, sf_dir):
    scored = peers.composite_scores(_peers(spark, sf_dir))
    rows = screener.screen(scored, fund_house="a", minimums={"observations": 500}, maximums={"max_drawdown_pct": -50.0})
    return rows.select("scheme_code", "scheme_category", "fund_house", "score", "volatility_pct", "max_drawdown_pct")


PLAIN_RULES = [r for r in [insights.SYNTHETIC, *insights.METRIC_RULES] if r.category != "benchmark"]


@query(
    "insight_counts",
    "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{r.name}' AS rule, count(*) AS n FROM full_ WHERE {r.where.format(limit=r.limit)}" for r in PLAIN_RULES)
    + ") WHERE n > 0",
)
def _(spark, sf_dir):
    rows = settled(_metrics(spark, sf_dir)).withColumns({"scheme_name": F.col("scheme_code"), "name": F.col("scheme_code")})
    names = F.array(*[F.lit(r.name) for r in PLAIN_RULES])
    return insights.matches(rows, PLAIN_RULES).select(F.get(names, F.col("rule")).alias("rule"), "n").distinct()


@query(
    "insights_leaders",
    """SELECT leader, scheme_code, round(value, 6) AS value FROM (
      SELECT l.leader AS leader, scheme_code, l.value AS value, row_number() OVER (PARTITION BY l.leader ORDER BY l.v DESC, CAST(scheme_code AS BIGINT)) AS n FROM (
        SELECT scheme_code, unnest([{'leader': 'best_sharpe', 'value': sharpe_ratio, 'v': sharpe_ratio}, {'leader': 'worst_sharpe', 'value': sharpe_ratio, 'v': -sharpe_ratio},
          {'leader': 'highest_cagr_3y', 'value': cagr_3y_pct, 'v': cagr_3y_pct}, {'leader': 'deepest_drawdown', 'value': max_drawdown_pct, 'v': -max_drawdown_pct},
          {'leader': 'highest_volatility', 'value': volatility_pct, 'v': volatility_pct}, {'leader': 'worst_rolling_3y', 'value': rolling_3y_min_pct, 'v': -rolling_3y_min_pct}]) AS l FROM full_)
      WHERE l.value IS NOT NULL) WHERE n = 1""",
)
def _(spark, sf_dir):
    return tidy(insights.leaders(_metrics(spark, sf_dir)))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dirty panel: line-level repeats, daily series with and without names, and short event series."""
    n = star_tasks(spark, sf_dir)
    # names are few beside rows: tasks hold their schemes' names, and the rows, exchanged once by scheme, are not sorted
    info = star_info(spark, sf_dir).select("scheme_code", "scheme_name")
    names = lambda prefix: info.withColumn("scheme_code", F.concat(F.lit(prefix), "scheme_code")).repartition(n, "scheme_code").hint("shuffle_hash")
    columns = ["scheme_code", "date", "nav", "data_source", "scheme_name"]
    k = F.col("scheme_code").try_cast("int")
    lines = star_lines(spark, sf_dir).withColumn("data_source", F.when(k % 7 == 0, "synthetic").otherwise("amfi"))
    lines = lines.select(F.concat(F.lit("l"), "scheme_code").alias("scheme_code"), "date", "nav", "data_source").repartition(n, "scheme_code")
    lines = lines.join(names("l"), "scheme_code", "left").select(*columns)
    unnamed = F.when(k % 10 == 4, F.concat(F.lit("Unknown scheme "), "scheme_code")).otherwise(F.col("scheme_name"))
    daily = star_nav(spark, sf_dir).join(names(""), "scheme_code", "left").withColumn("scheme_name", unnamed).select(*columns)
    short = event_nav(spark, sf_dir).withColumns({"scheme_name": F.concat(F.lit("Events "), "scheme_code")})
    short = short.withColumn("scheme_code", F.concat(F.lit("e"), "scheme_code")).select(*columns).repartition(n, "scheme_code")
    return lines.unionByName(daily).unionByName(short)


@query("dq_findings", 'SELECT scheme_code, severity, "check", affected_rows FROM fnd')
def _(spark, sf_dir):
    return validation.findings(_raw(spark, sf_dir), TODAY).drop("message")


@query("dq_absent", """SELECT scheme_code, 'CRITICAL' AS severity, 'no_data' AS "check", 0 AS affected_rows FROM info
    WHERE scheme_code NOT IN (SELECT scheme_code FROM nav WHERE date >= DATE '2001-10-20')""")  # fmt: skip
def _(spark, sf_dir):
    """Schemes of the dimension without any NAV in the last days."""
    late = star_nav(spark, sf_dir).where(F.col("date") >= "2001-10-20").withColumn("scheme_name", F.lit("n"))
    found = validation.findings(late, TODAY, expected=star_info(spark, sf_dir).select("scheme_code"))
    return found.where("check = 'no_data'").drop("message")


@query(
    "dq_coverage",
    """SELECT scheme_code, scheme_name, observations, first_date, last_date, stale AS staleness_days, round_even(years, 2) AS history_years, data_source FROM ing""",
)
def _(spark, sf_dir):
    return validation.coverage(_raw(spark, sf_dir), TODAY)


@query(
    "dq_summary",
    """SELECT (SELECT count(*) FROM ing) AS schemes, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'WARNING') AS warning,
    count(*) FILTER (severity = 'INFO') AS info, count(DISTINCT scheme_code) FILTER (severity = 'CRITICAL') AS unusable FROM fnd""",
)
def _(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return validation.summary(validation.findings(raw, TODAY), raw)


@query(
    "dq_usable",
    "SELECT r.scheme_code, count(*) AS rows_kept FROM raw r WHERE r.scheme_code NOT IN (SELECT scheme_code FROM fnd WHERE severity = 'CRITICAL') GROUP BY r.scheme_code",
)
def _(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return validation.usable(raw, validation.findings(raw, TODAY)).groupBy("scheme_code").agg(F.count("*").alias("rows_kept"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: trailing returns, risk and drawdown of every scheme, named and ranked by Sharpe ratio."""
    nav = star_nav(spark, sf_dir)
    rows = returns.trailing_returns(nav)
    for more in (risk.return_moments(nav), risk.current_drawdown(nav)):
        rows = rows.join(more, "scheme_code", "left")
    rows = rows.join(star_info(spark, sf_dir), "scheme_code", "left")
    return tidy(rows.orderBy(F.col("sharpe_ratio").desc_nulls_last(), "scheme_code"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)
