"""Queries for chart aggregates."""

from __future__ import annotations

from tabwright.operators import charts as ch
from tabwright.plans.registry import add, report
from tabwright.plans.report_queries import EVENTS, MISSING_SHARE, histogram_sql, union

add("chart_histogram", report("dirty_events", ch.chart_histogram, "value"), histogram_sql("dirty_events", "value", 20))
_kde = (
    "WITH s AS (SELECT count(value) AS n, greatest(1.06 * stddev_pop(value) * pow(count(value), -0.2), 1e-9) AS w, min(value) AS lo, max(value) AS hi FROM dirty_events), "
    "g AS (SELECT CASE WHEN i = 79 THEN hi ELSE lo + i * ((hi - lo) / 79) END AS x, n, w FROM s, range(80) t(i)) "
    "SELECT x, sum(exp(-0.5 * ((x - value) / w) * ((x - value) / w))) / (min(n) * min(w) * sqrt(2 * pi())) AS density FROM g, dirty_events WHERE value IS NOT NULL GROUP BY x"
)
add("chart_kde", report("dirty_events", ch.chart_kde, "value"), _kde)
add("chart_violin", report("dirty_events", ch.chart_violin, "value"), _kde)
_bar = (
    "SELECT coalesce(event_type, 'None') AS value, count(*) AS count, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM dirty_events) * 100 AS percentage "
    "FROM dirty_events GROUP BY event_type ORDER BY count DESC, value LIMIT 30"
)
add("chart_bar", report("dirty_events", ch.chart_bar, "event_type"), _bar)
add("chart_class_distribution", report("dirty_events", ch.chart_class_distribution, "event_type"), _bar)


def _box(source: str, c: str, label: str) -> str:
    return (
        f"SELECT {label}, count(v) AS count, min(v) AS min, min(q1) AS q1, quantile_cont(v, 0.5) AS median, min(q3) AS q3, max(v) AS max, "
        "min(q1) - 1.5 * (min(q3) - min(q1)) AS lower_fence, min(q3) + 1.5 * (min(q3) - min(q1)) AS upper_fence, "
        "count(CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1 END) AS outlier_count FROM "
        f"(SELECT {c} AS v, g, quantile_cont({c}, 0.25) OVER (PARTITION BY g) AS q1, quantile_cont({c}, 0.75) OVER (PARTITION BY g) AS q3 FROM ({source}) WHERE {c} IS NOT NULL) GROUP BY g"
    )


_one_box = _box("SELECT value, 0 AS g FROM dirty_events", "value", "'value' AS \"column\"")
add("chart_box", report("dirty_events", ch.chart_box, "value"), _one_box)
add("chart_outlier", report("dirty_events", ch.chart_outlier, "value"), _one_box)
add("box_outliers", report("dirty_events", ch.box_outliers, "value", ["event_id"]),
    "SELECT value FROM dirty_events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM dirty_events) "
    "WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) ORDER BY event_id LIMIT 100")
add("chart_grouped_box", report("dirty_events", ch.chart_grouped_box, "value", "event_type"),
    _box("SELECT value, event_type AS g FROM dirty_events WHERE event_type IS NOT NULL", "value", 'g AS "group"'))
add("chart_grouped_box_many", report("lineitem", lambda df: ch.chart_grouped_box(df.selectExpr("l_quantity", "CAST(l_orderkey % 10000 AS STRING) AS g"), "l_quantity", "g")),
    _box("SELECT l_quantity, CAST(l_orderkey % 10000 AS VARCHAR) AS g FROM lineitem", "l_quantity", 'g AS "group"'))
add("chart_scatter", report("dirty_events", ch.chart_scatter, "user_id", "value", 1000, "event_id"),
    "SELECT CAST(user_id AS DOUBLE) AS x, value AS y FROM dirty_events WHERE value IS NOT NULL ORDER BY md5(concat_ws('|', '42', event_id)), event_id LIMIT 1000")
add("scatter_sample_large", report("lineitem", ch.chart_scatter, "l_quantity", "l_extendedprice", 5000, ["l_orderkey", "l_linenumber"]),
    "SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem ORDER BY md5(concat_ws('|', '42', l_orderkey, l_linenumber)) LIMIT 5000")
add("scatter_correlation", report("dirty_events", ch.pearson, "user_id", "value"), "SELECT corr(user_id, value) AS correlation FROM dirty_events WHERE value IS NOT NULL")

PRICES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _matrix(columns: list[str], template: str) -> str:
    return " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, " + ("CAST(1 AS DOUBLE) AS value" if x == y else template.format(x=x, y=y)) for x in columns for y in columns)


add("chart_corr_pearson", report("lineitem", ch.chart_corr_pearson, PRICES), _matrix(PRICES, "(SELECT corr({x}, {y}) FROM lineitem) AS value"))
WIDE = [*PRICES, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
add("chart_corr_wide", report("lineitem", ch.chart_corr_pearson, WIDE), _matrix(WIDE, "(SELECT corr({x}, {y}) FROM lineitem) AS value"))
MIXED_COLUMNS = ["user_id", "value", "event_id"]
_rank = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
_spearman = _matrix(
    MIXED_COLUMNS,
    f"(SELECT corr(a, b) FROM (SELECT CAST({_rank.format(c='{x}')} AS DOUBLE) AS a, CAST({_rank.format(c='{y}')} AS DOUBLE) AS b FROM dirty_events WHERE {{x}} IS NOT NULL AND {{y}} IS NOT NULL)) AS value")
add("chart_corr_spearman", report("dirty_events", ch.chart_corr_spearman, MIXED_COLUMNS), _spearman)
add("chart_corr_spearman_ranges", report("dirty_events", ch.chart_corr_spearman, MIXED_COLUMNS, 1000), _spearman)
add("chart_pair_plot", report("dirty_events", ch.chart_pair_plot, ["user_id", "value", "event_id"], 1000, "event_id"),
    "SELECT CAST(user_id AS DOUBLE) AS user_id, value, CAST(event_id AS DOUBLE) AS event_id FROM dirty_events WHERE value IS NOT NULL "
    "ORDER BY md5(concat_ws('|', '42', dirty_events.event_id)) LIMIT 1000")
add("chart_line_points", report("dirty_events", ch.line_points, "ts", "value"),
    "SELECT ts AS x, value AS y FROM dirty_events WHERE value IS NOT NULL ORDER BY x, y LIMIT 2000")
_line = (
    "WITH p AS (SELECT {x} AS x, CAST({y} AS DOUBLE) AS y, {at} AS pos FROM {view} WHERE {x} IS NOT NULL AND {y} IS NOT NULL), "
    "s AS (SELECT min(pos) AS lo, (max(pos) - min(pos)) / {bins} AS w FROM p), "
    "b AS (SELECT CAST(least(floor((pos - lo) / w), {bins} - 1) AS BIGINT) AS bin, x, y FROM p, s) "
    "SELECT bin, min(x) AS x_first, max(x) AS x_last, count(*) AS count, (list(y ORDER BY x, y))[1] AS y_first, (list(y ORDER BY x DESC, y DESC))[1] AS y_last, "
    "min(y) AS y_min, max(y) AS y_max, avg(y) AS y_mean FROM b GROUP BY bin"
)
add("chart_line", report("dirty_events", ch.chart_line, "ts", "value"), _line.format(x="ts", y="value", at="CAST(epoch_us(ts) AS DOUBLE)", view="dirty_events", bins=2000))
add("chart_line_numbers", report("part", ch.chart_line, "p_size", "p_retailprice", 20), _line.format(x="p_size", y="p_retailprice", at="CAST(p_size AS DOUBLE)", view="part", bins=20))
add("chart_missing_bar", report("dirty_events", ch.chart_missing_bar),
    union(EVENTS, "SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, " + MISSING_SHARE + " AS percentage FROM dirty_events"))
_rows = "(SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', event_id))) - 1 AS i FROM dirty_events)"
add("chart_missing_heatmap", report("dirty_events", ch.chart_missing_heatmap, 200, "event_id"),
    union(EVENTS, f"SELECT i AS row, '{{c}}' AS \"column\", {{c}} IS NULL AS missing FROM {_rows} WHERE i < 200"))
_roles = {"event_id": "numeric", "ts": "date", "user_id": "numeric", "event_type": "categorical", "value": "numeric", "amount_text": "categorical", "flag_text": "categorical", "constant_text": "categorical"}
add("chart_metadata", report("dirty_events", ch.chart_metadata), " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS \"column\", '{r}' AS role, count(*) - count({c}) AS missing_count FROM dirty_events" for i, (c, r) in enumerate(_roles.items())))
_reasons = ", ".join(f"('{kind}', '{reason}')" for kind, reason in ch.REASONS.items())
add("chart_recommendations", report("dirty_events", ch.chart_recommendations),
    "SELECT CAST(r AS BIGINT) AS rank, k AS chart_type, c AS columns, reason FROM (VALUES (1, 'histogram', 'event_id'), (2, 'kde', 'event_id'), (3, 'box', 'event_id'), (4, 'bar', 'event_type'), "
    "(5, 'scatter', 'event_id,user_id'), (6, 'correlation_heatmap', 'event_id,user_id,value'), (7, 'grouped_box', 'event_id,event_type'), (8, 'missing_bar', ''), (9, 'missing_heatmap', '')) t(r, k, c) "
    f"JOIN (VALUES {_reasons}) w(kind, reason) ON kind = k "
    "WHERE r < 8 OR (SELECT count(*) FROM dirty_events WHERE event_type IS NULL OR value IS NULL) > 0")
add("distribution_stats", report("spiky_events", ch.distribution_stats, "value"),
    "SELECT count(value) AS count, avg(value) AS mean, quantile_cont(value, 0.5) AS median, min(value) AS min, max(value) AS max FROM spiky_events WHERE NOT isnan(value) AND NOT isinf(value)")
