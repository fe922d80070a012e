"""Queries for profiles, quality issues, validation, contracts and readiness."""

from __future__ import annotations

from tabwright.functions.text import DIRTY_WORDS, FLOAT_LITERAL
from tabwright.operators import contract as ct, profile as pf, readiness as rd, validate as vd
from tabwright.operators.contract import ExpectedColumn
from tabwright.plans.registry import add, report


def union(columns, template: str) -> str:
    """One SELECT per column; ``{c}`` is the column, ``{t}`` what it maps to."""
    pairs = columns.items() if isinstance(columns, dict) else ((c, None) for c in columns)
    return " UNION ALL ".join(template.format(c=c, t=t) for c, t in pairs)


def words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
}
EVENTS = ["event_id", "ts", "user_id", "event_type", "value", "amount_text", "flag_text", "constant_text"]
EVENT_NUMBERS, EVENT_TEXTS = ["event_id", "user_id", "value"], ["event_type", "amount_text", "flag_text", "constant_text"]
WORN_NUMBERS = ["o_custkey", "price", "constant_number"]
WORN_TEXTS = ["o_orderstatus", "priority", "customer_text", "day_text", "constant_text"]
WORN = WORN_NUMBERS + WORN_TEXTS
SHARE = "coalesce(CAST({part} AS DOUBLE) / nullif(count(*), 0) * 100, 0)"
MISSING_SHARE = SHARE.format(part="(count(*) - count({c}))")

# --- profiles ----------------------------------------------------------------------
add("profile_table", report("worn_orders", pf.profile_table),
    "WITH d AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(n - 1) AS BIGINT) AS k FROM "
    f"(SELECT count(*) AS n FROM worn_orders GROUP BY {', '.join(WORN)})), "
    f"m AS (SELECT {' + '.join(f'count(*) - count({c})' for c in WORN)} AS holes FROM worn_orders) "
    f"SELECT n AS row_count, CAST({len(WORN)} AS BIGINT) AS column_count, k AS duplicate_row_count, CAST(k AS DOUBLE) / n * 100 AS duplicate_row_percentage, "
    f"holes AS total_missing_values, CAST(holes AS DOUBLE) / (n * {len(WORN)}) * 100 AS total_missing_percentage FROM d, m")
add("null_counts", report("dirty_events", pf.null_counts),
    union(EVENTS, "SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, " + MISSING_SHARE + " AS missing_percentage FROM dirty_events"))
add("profile_numeric", report("lineitem", pf.profile_numeric), union(LINEITEM, (
    "SELECT '{c}' AS \"column\", '{t}' AS inferred_type, count(*) AS count, count(*) - count({c}) AS missing_count, " + MISSING_SHARE + " AS missing_percentage, "
    "avg({c}) AS mean, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, stddev_pop({c}) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
    "quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75, "
    "quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25) AS iqr, min({c}) = max({c}) AS is_constant FROM lineitem")))
FENCED = (
    "(SELECT {c} AS v, {order} AS pos, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM {view}, "
    "(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {view}))"
)
_fenced_events = FENCED.replace("{view}", "dirty_events").replace("{order}", "event_id")
add("iqr_outliers", report("dirty_events", pf.iqr_outliers, ["event_id"]), union(EVENT_NUMBERS, (
    "SELECT '{c}' AS \"column\", min(lo) AS lower_bound, min(hi) AS upper_bound, count(CASE WHEN v < lo OR v > hi THEN 1 END) AS outlier_count, "
    "CAST(count(CASE WHEN v < lo OR v > hi THEN 1 END) AS DOUBLE) / count(v) * 100 AS outlier_percentage, "
    + ", ".join(f"(list(CAST(v AS DOUBLE) ORDER BY pos) FILTER (WHERE v < lo OR v > hi))[{i}] AS sample_{i}" for i in range(1, 6))
    + f" FROM {_fenced_events}")))


def histogram_sql(view: str, c: str, bins: int) -> str:
    """Checking SQL ``(bin, bin_start, bin_end, count)``, empty bins included."""
    x = f"CAST({c} AS DOUBLE)"
    return (
        f"SELECT CAST(b.i AS BIGINT) AS bin, s.lo + b.i * s.w AS bin_start, CASE WHEN b.i = {bins - 1} THEN s.hi ELSE s.lo + (b.i + 1) * s.w END AS bin_end, "
        f"count(d.j) AS count FROM (SELECT min({x}) AS lo, max({x}) AS hi, (max({x}) - min({x})) / {bins} AS w FROM {view}) s, range({bins}) b(i) LEFT JOIN "
        f"(SELECT CASE WHEN x < lo + j * w THEN j - 1 WHEN j < {bins - 1} AND x >= lo + (j + 1) * w THEN j + 1 ELSE j END AS j FROM "
        f"(SELECT {x} AS x, lo, w, least(CAST(floor(({x} - lo) / w) AS BIGINT), {bins - 1}) AS j FROM {view}, "
        f"(SELECT min({x}) AS lo, (max({x}) - min({x})) / {bins} AS w FROM {view}) WHERE {c} IS NOT NULL)) d ON d.j = b.i GROUP BY b.i, s.lo, s.hi, s.w"
    )


add("profile_histogram", report("lineitem", pf.profile_histogram),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", * FROM ({histogram_sql('lineitem', c, 10)})" for c in LINEITEM))
add("constant_numeric", report("worn_orders", pf.constant_numeric),
    union(WORN_NUMBERS, "SELECT '{c}' AS \"column\", min({c}) = max({c}) AS is_constant FROM worn_orders"))
DATE_LOOKS = "count(CASE WHEN len({c}) - len(replace(replace({c}, '-', ''), '/', '')) = 2 THEN 1 END)"
add("profile_dates", report("worn_orders", pf.profile_dates),
    "SELECT 'day_text' AS \"column\", 'string_as_date' AS inferred_type, count(*) AS count, count(*) - count(day_text) AS missing_count, "
    + MISSING_SHARE.format(c="day_text") + f" AS missing_percentage, {DATE_LOOKS.format(c='day_text')} AS valid_date_count, "
    f"count(day_text) - {DATE_LOOKS.format(c='day_text')} AS invalid_date_count, CAST(NULL AS VARCHAR) AS min_date, CAST(NULL AS VARCHAR) AS max_date FROM worn_orders")
add("profile_timestamps", report("orders", pf.profile_dates),
    "SELECT 'o_orderdate' AS \"column\", 'timestamp_ntz' AS inferred_type, count(*) AS count, count(*) - count(o_orderdate) AS missing_count, "
    + MISSING_SHARE.format(c="o_orderdate") + " AS missing_percentage, count(o_orderdate) AS valid_date_count, CAST(0 AS BIGINT) AS invalid_date_count, "
    "CAST(min(o_orderdate) AS VARCHAR) AS min_date, CAST(max(o_orderdate) AS VARCHAR) AS max_date FROM orders")
add("profile_categorical", report("dirty_events", pf.profile_categorical), union(EVENT_TEXTS, (
    "SELECT '{c}' AS \"column\", 'string' AS inferred_type, count(*) AS count, count(*) - count({c}) AS missing_count, " + MISSING_SHARE + " AS missing_percentage, "
    "count(DISTINCT {c}) AS unique_count, CAST(count(DISTINCT {c}) AS DOUBLE) / count(*) AS cardinality_ratio, "
    "count(DISTINCT {c}) = 1 AND count(*) = count({c}) AS is_constant FROM dirty_events")))
_top = (
    "SELECT * FROM (SELECT '{c}' AS \"column\", row_number() OVER (ORDER BY count(*) DESC, {c} DESC) AS rank, {c} AS value, count(*) AS count, "
    "CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM VIEW) * 100 AS percentage FROM VIEW WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 10"
)
add("top_values", report("dirty_events", pf.top_values), union(EVENT_TEXTS, _top.replace("VIEW", "dirty_events")))
add("top_values_texts", report("documents", pf.top_values), union(["text", "lang", "source"], _top.replace("VIEW", "documents")))
add("top_values_pages", report("pages", pf.top_values), union(["url", "html"], _top.replace("VIEW", "pages")))
NUMERIC_LOOKS = "count(CASE WHEN regexp_matches(trim(replace(replace(replace({c}, '$', ''), ',', ''), '%', '')), '" + FLOAT_LITERAL.replace("{", "{{").replace("}", "}}") + "') THEN 1 END)"
MIXED = f"(count({{c}}) > 0 AND CAST({NUMERIC_LOOKS} AS DOUBLE) / nullif(count({{c}}), 0) > 0.6 AND {NUMERIC_LOOKS} < count({{c}}))"
add("mixed_type_check", report("worn_orders", pf.mixed_type_check), union(WORN_TEXTS, (
    f"SELECT '{{c}}' AS \"column\", count({{c}}) AS non_null_count, {NUMERIC_LOOKS} AS numeric_looks, {MIXED} AS is_mixed, count(*) - {NUMERIC_LOOKS} AS affected_rows, "
    f"coalesce((SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {{c}} AS v FROM worn_orders WHERE lower({{c}}) IN ({words(DIRTY_WORDS)}) ORDER BY v LIMIT 5)), '') AS dirty_samples "
    "FROM worn_orders")))
add("date_string_check", report("date_text_orders", pf.date_string_check),
    f"SELECT 'order_day' AS \"column\", count(order_day) AS non_null_count, {DATE_LOOKS.format(c='order_day')} AS valid_date_count, "
    f"count(order_day) - {DATE_LOOKS.format(c='order_day')} AS invalid_date_count, CAST({DATE_LOOKS.format(c='order_day')} AS DOUBLE) / count(order_day) > 0.7 AS string_as_date FROM date_text_orders")

# --- quality issues ----------------------------------------------------------------
_fenced_worn = FENCED.replace("{view}", "worn_orders").replace("{order}", "0")
_nothing = "CAST(NULL AS VARCHAR)"
ISSUES = (
    f"SELECT 'DUPLICATE_ROWS' AS code, CASE WHEN round(CAST(k AS DOUBLE) / n * 100, 2) < 15 THEN 'warning' ELSE 'critical' END AS severity, {_nothing} AS \"column\", k AS affected_rows "
    f"FROM (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(n - 1) AS BIGINT) AS k FROM (SELECT count(*) AS n FROM worn_orders GROUP BY {', '.join(WORN)})) WHERE k > 0 UNION ALL "
    + union(WORN, "SELECT 'HIGH_MISSINGNESS', CASE WHEN round(p, 2) > 60 THEN 'critical' ELSE 'warning' END, '{c}', k FROM "
                  "(SELECT count(*) - count({c}) AS k, " + MISSING_SHARE + " AS p FROM worn_orders) WHERE round(p, 2) > 30")
    + " UNION ALL " + union(WORN_NUMBERS, f"SELECT 'OUTLIERS_DETECTED', 'warning', '{{c}}', k FROM (SELECT count(*) AS k FROM {_fenced_worn} WHERE v < lo OR v > hi) WHERE k > 0")
    + " UNION ALL " + union(WORN_NUMBERS, "SELECT 'CONSTANT_COLUMN', 'warning', '{c}', n FROM (SELECT count(*) AS n, min({c}) = max({c}) AS one FROM worn_orders) WHERE one")
    + " UNION ALL " + union(WORN_TEXTS, "SELECT 'CONSTANT_COLUMN', 'warning', '{c}', n FROM (SELECT count(*) AS n, count({c}) AS k, count(DISTINCT {c}) AS d FROM worn_orders) WHERE d = 1 AND k = n")
    + " UNION ALL " + union(WORN_TEXTS, f"SELECT 'MIXED_DATA_TYPES', 'critical', '{{c}}', k FROM (SELECT {MIXED} AS mixed, count(*) - {NUMERIC_LOOKS} AS k FROM worn_orders) WHERE mixed")
)
# Samples per issue: the fences, constants and words as the rules above find them.
_extremes = union(WORN_NUMBERS, "SELECT 'OUTLIERS_DETECTED' AS code, '{c}' AS \"column\", concat_ws('|', CASE WHEN min(v) < min(lo) OR min(v) > min(hi) THEN printf('%.2f', CAST(min(v) AS DOUBLE)) END, "
                  f"CASE WHEN max(v) < min(lo) OR max(v) > min(hi) THEN printf('%.2f', CAST(max(v) AS DOUBLE)) END) AS s FROM {_fenced_worn}")
_single = union(WORN_NUMBERS, "SELECT 'CONSTANT_COLUMN', '{c}', printf('%.2f', CAST(min({c}) AS DOUBLE)) FROM worn_orders") + " UNION ALL " + union(WORN_TEXTS, "SELECT 'CONSTANT_COLUMN', '{c}', min({c}) FROM worn_orders")
_dirt = union(WORN_TEXTS, f"SELECT 'MIXED_DATA_TYPES', '{{c}}', coalesce((SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {{c}} AS v FROM worn_orders WHERE lower({{c}}) IN ({words(DIRTY_WORDS)}) ORDER BY v LIMIT 5)), '')")
_actions = ", ".join(f"('{code}', '{text}')" for code, text in pf.ACTIONS.items())
add("quality_issues", report("worn_orders", pf.quality_issues),
    f"WITH i AS ({ISSUES}), s AS ({_extremes} UNION ALL {_single} UNION ALL {_dirt}), a(code, suggested_action) AS (VALUES {_actions}) "
    "SELECT i.*, coalesce(s.s, '') AS sample_values, a.suggested_action FROM i LEFT JOIN s ON s.code = i.code AND s.\"column\" = i.\"column\" JOIN a ON a.code = i.code")
add("health_score", report("worn_orders", pf.health_score),
    f"WITH i AS ({ISSUES}), p AS (SELECT count(CASE WHEN severity = 'critical' THEN 1 END) AS c, count(CASE WHEN severity = 'warning' THEN 1 END) AS w FROM i), "
    f"m AS (SELECT round(CAST({' + '.join(f'count(*) - count({c})' for c in WORN)} AS DOUBLE) / (count(*) * {len(WORN)}) * 100, 2) AS holes FROM worn_orders), "
    f"d AS (SELECT round(CAST(sum(n - 1) AS DOUBLE) / CAST(sum(n) AS DOUBLE) * 100, 2) AS copies FROM (SELECT count(*) AS n FROM worn_orders GROUP BY {', '.join(WORN)})) "
    "SELECT holes AS missing_percentage, copies AS duplicate_percentage, c AS critical_issues, w AS warning_issues, "
    "greatest(0.0, least(100.0, round(100.0 - least(holes * 0.8, 30.0) - least(copies * 1.5, 25.0) - 10.0 * c - 4.0 * w, 1))) AS health_score FROM p, m, d")

# --- validation --------------------------------------------------------------------
_duplicates = (
    f"SELECT 'DUPLICATE_RECORDS' AS rule, CASE WHEN k < 10 THEN 'warning' ELSE 'critical' END AS severity, {_nothing} AS \"column\", k AS row_count "
    f"FROM (SELECT CAST(sum(n - 1) AS BIGINT) AS k FROM (SELECT count(*) AS n FROM worn_orders GROUP BY {', '.join(WORN)})) WHERE k > 0"
)
_nulls = union(WORN, "SELECT 'NULL_INTEGRITY' AS rule, CASE WHEN p > 50 THEN 'critical' WHEN p > 10 THEN 'warning' ELSE 'info' END AS severity, '{c}' AS \"column\", k AS row_count "
                     "FROM (SELECT count(*) - count({c}) AS k, round(" + MISSING_SHARE + ", 1) AS p FROM worn_orders) WHERE k > 0")
_constant = union(WORN, "SELECT 'CONSTANT_COLUMNS_CHECK' AS rule, 'warning' AS severity, '{c}' AS \"column\", n AS row_count "
                        "FROM (SELECT count(*) AS n, count(DISTINCT {c}) AS d FROM worn_orders) WHERE d <= 1 AND n > 1")
add("validate_non_empty", report("orders", vd.validate_non_empty),
    f"SELECT 'NON_EMPTY_DATASET' AS rule, 'critical' AS severity, {_nothing} AS \"column\", n AS row_count FROM (SELECT count(*) AS n FROM orders) WHERE n = 0")
add("validate_duplicates", report("worn_orders", vd.validate_duplicates), _duplicates)
add("validate_nulls", report("worn_orders", vd.validate_nulls), _nulls)
add("validate_constant", report("worn_orders", vd.validate_constant), _constant)
add("validate_finite", report("spiky_events", vd.validate_finite),
    "SELECT 'NUMERICAL_FINITENESS' AS rule, 'critical' AS severity, 'value' AS \"column\", count(*) AS row_count FROM spiky_events WHERE isnan(value) OR isinf(value)")
add("validate_column_names", lambda spark, sf_dir: vd.validate_column_names(_odd_names(spark, sf_dir)),
    "SELECT 'COLUMN_NAMES_VALIDITY' AS rule, 'warning' AS severity, c AS \"column\", CAST(0 AS BIGINT) AS row_count FROM (VALUES (' o_orderkey'), ('Status'), ('status')) t(c)")
add("validation_report", report("worn_orders", vd.validation_report),
    f"SELECT CASE WHEN count(CASE WHEN severity = 'critical' THEN 1 END) > 0 THEN 'failed' WHEN count(CASE WHEN severity = 'warning' THEN 1 END) > 0 THEN 'warning' ELSE 'passed' END "
    f"AS overall_status, count(*) AS violations_count, CAST(6 AS BIGINT) AS rules_checked FROM ({_duplicates} UNION ALL {_nulls} UNION ALL {_constant})")


def _odd_names(spark, sf_dir):
    from tabwright.plans.views import table

    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS ` o_orderkey`", "o_orderstatus AS `Status`", "o_orderpriority AS `status`")


# --- contracts ---------------------------------------------------------------------
CONTRACT = [
    ExpectedColumn("event_id", "integer", nullable=False, min_value=0),
    ExpectedColumn("ts", "date"),
    ExpectedColumn("user_id", "string"),
    ExpectedColumn("event_type", "string", nullable=False, allowed_values=("Click", "view", "purchase")),
    ExpectedColumn("value", "float", nullable=False, min_value=1, max_value=100),
    ExpectedColumn("amount_text", "integer"),
    ExpectedColumn("flag_text", "string", regex_pattern="yes|F$"),
    ExpectedColumn("session", "string"),
    ExpectedColumn("note", "string", required=False),
]


def _issue(c: str, severity: str, kind: str, expected: str, actual: str, test: str, sample: str | None = None) -> str:
    samples = "''" if sample is None else f"coalesce((SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {sample} AS v FROM dirty_events WHERE {test} ORDER BY v LIMIT 5)), '')"
    return (
        f"SELECT '{c}' AS \"column\", '{severity}' AS severity, '{kind}' AS issue_type, '{expected}' AS expected_type, {actual} AS actual_type, "
        f"n AS affected_rows, {samples} AS sample_values FROM (SELECT count(*) AS n FROM dirty_events WHERE {test})"
    )


_int_literal = r"regexp_matches(trim(replace(replace(amount_text, '$', ''), ',', '')), '^[+-]?[0-9]+(?:_[0-9]+)*$')"
_checks = {
    "contract_nulls": " UNION ALL ".join(
        f"SELECT * FROM ({_issue(c, 'critical', 'nullability_violation', e, t, f'{c} IS NULL')}) WHERE affected_rows > 0"
        for c, e, t in (("event_id", "integer", "'bigint'"), ("event_type", "string", "'string'"), ("value", "float", "'double'"))),
    "contract_type_mismatch": _issue("amount_text", "critical", "type_mismatch", "integer", "'string'", f"amount_text IS NOT NULL AND NOT {_int_literal}", "amount_text"),
    "contract_date_mismatch": _issue("ts", "warning", "type_mismatch", "date", "'timestamp_ntz'", "true"),
    "contract_enum": _issue("event_type", "warning", "enum_violation", "string", "'string'", "lower(event_type) NOT IN ('click', 'view', 'purchase')", "event_type"),
    "contract_range": _issue("value", "warning", "constraint_violation", "float", "'double'", "value < 1 OR value > 100", "CAST(value AS VARCHAR)"),
    "contract_regex": _issue("flag_text", "warning", "constraint_violation", "string", "'string'", "NOT regexp_matches(flag_text, '^(?:yes|F$)')", "flag_text"),
    "contract_missing": _issue("session", "critical", "missing_column", "string", _nothing, "true") + " UNION ALL " + _issue("note", "warning", "missing_column", "string", _nothing, "true"),
}


def _issues_about(kind: str, columns: list[str]):
    return lambda df: ct.contract_issues(df, CONTRACT, [kind]).filter(f"column in ({words(columns)})")


add("contract_nulls", report("dirty_events", ct.contract_issues, CONTRACT, ["nullability_violation"]), _checks["contract_nulls"])
add("contract_type_mismatch", report("dirty_events", _issues_about("type_mismatch", ["amount_text"])), _checks["contract_type_mismatch"])
add("contract_date_mismatch", report("dirty_events", _issues_about("type_mismatch", ["ts"])), _checks["contract_date_mismatch"])
add("contract_enum", report("dirty_events", ct.contract_issues, CONTRACT, ["enum_violation"]), _checks["contract_enum"])
_evens = ExpectedColumn("l_orderkey", "integer", allowed_values=tuple(range(0, 10_000, 2)))
_odd = "l_orderkey % 2 = 1 OR l_orderkey >= 10000"
add("contract_enum_long", report("lineitem", ct.contract_issues, [_evens], ["enum_violation"]),
    "SELECT 'l_orderkey' AS \"column\", 'warning' AS severity, 'enum_violation' AS issue_type, 'integer' AS expected_type, 'bigint' AS actual_type, count(*) AS affected_rows, "
    f"(SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS v FROM lineitem WHERE {_odd} ORDER BY v LIMIT 5)) AS sample_values FROM lineitem WHERE {_odd}")
add("contract_range", report("dirty_events", _issues_about("constraint_violation", ["value"])), _checks["contract_range"])
add("contract_regex", report("dirty_events", _issues_about("constraint_violation", ["flag_text"])), _checks["contract_regex"])
add("contract_missing", report("dirty_events", ct.contract_issues, CONTRACT, ["missing_column"]), _checks["contract_missing"])
add("contract_from_schema", report("orders", ct.contract_from_schema),
    "SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'float' WHEN 'TIMESTAMP' THEN 'datetime' ELSE 'string' END AS data_type, "
    "true AS required, true AS nullable FROM (DESCRIBE SELECT * FROM orders)")
_column_kinds = (
    ("event_id", "integer", "bigint", "count(CASE WHEN event_id IS NULL OR event_id < 0 THEN 1 END)", "constraint_violation"), ("ts", "date", "timestamp_ntz", "1", "type_mismatch"),
    ("user_id", "string", "bigint", "1", "type_mismatch"), ("event_type", "string", "string", "count(CASE WHEN event_type IS NULL OR event_type NOT IN ('click', 'view', 'purchase') THEN 1 END)", "constraint_violation"),
    ("value", "float", "double", "count(CASE WHEN value IS NULL OR value < 1 OR value > 100 THEN 1 END)", "constraint_violation"), ("amount_text", "integer", "string", "1", "type_mismatch"),
    ("flag_text", "string", "string", "count(CASE WHEN NOT regexp_matches(flag_text, '^(?:yes|F$)') THEN 1 END)", "constraint_violation"),
)
add("contract_columns", report("dirty_events", ct.contract_columns, CONTRACT), "SELECT 'constant_text' AS \"column\", 'unexpected' AS status, CAST(NULL AS VARCHAR) AS expected_type, 'string' AS actual_type UNION ALL "
    + " UNION ALL ".join(f"SELECT '{c}', CASE WHEN k > 0 THEN '{bad}' ELSE 'matched' END, '{e}', '{t}' FROM (SELECT {k} AS k FROM dirty_events LIMIT 1)" for c, e, t, k, bad in _column_kinds))
add("contract_report", report("dirty_events", ct.contract_report, CONTRACT),
    f"SELECT CASE WHEN count(CASE WHEN severity = 'critical' THEN 1 END) > 0 THEN 'incompatible' WHEN count(*) > 0 THEN 'warnings' ELSE 'compatible' END AS compatibility_status, "
    f"CAST({len(CONTRACT)} AS BIGINT) AS total_expected_columns, CAST({len(CONTRACT) - 2} AS BIGINT) AS matched_columns_count, 'session,note' AS missing_columns, "
    "'constant_text' AS unexpected_columns, count(CASE WHEN severity = 'critical' THEN 1 END) AS critical_issues, count(CASE WHEN severity = 'warning' THEN 1 END) AS warning_issues "
    f"FROM ({' UNION ALL '.join(_checks.values())}) WHERE affected_rows > 0 OR issue_type = 'type_mismatch'")

# --- readiness ---------------------------------------------------------------------
_finding = "SELECT '{category}' AS category, {severity} AS severity, '{code}' AS code, {column} AS \"column\", {rows} AS rows_affected, {points} AS points, '{operation}' AS recommended_operation FROM ({source}) WHERE {test}"
WORN_FEATURES = {c: "fill_missing_median" if c in WORN_NUMBERS else "fill_missing_constant" for c in WORN if c != "priority"}
_target_nulls = _finding.format(
    category="target_quality", severity="'critical'", code="TARGET_NULLS", column="'priority'", rows="k", points="CAST(25 AS DOUBLE)", operation="drop_missing",
    source="SELECT count(*) - count(priority) AS k FROM worn_orders", test="k > 0")
_feature_nulls = " UNION ALL ".join(_finding.format(
    category="missing_data", severity="CASE WHEN p < 30 THEN 'warning' ELSE 'critical' END", code="FEATURE_NULLS", column=f"'{c}'", rows="k",
    points="least(p * CAST(0.15 AS DOUBLE), CAST(8 AS DOUBLE))", operation=operation,
    source=f"SELECT count(*) - count({c}) AS k, round({MISSING_SHARE.format(c=c)}, 1) AS p FROM worn_orders", test="k > 0") for c, operation in WORN_FEATURES.items())
_constant_features = " UNION ALL ".join(_finding.format(
    category="feature_types", severity="'warning'", code="CONSTANT_FEATURE", column=f"'{c}'", rows="n", points="CAST(5 AS DOUBLE)", operation="drop_column",
    source=f"SELECT count(*) AS n, count(DISTINCT {c}) AS d FROM worn_orders", test="d <= 1") for c in WORN_FEATURES)
add("ml_target_nulls", report("worn_orders", rd.ml_findings, "classification", "priority", ["TARGET_NULLS"]), _target_nulls)
add("ml_target_classes", report("worn_orders", rd.ml_target_classes, "priority"),
    "SELECT 'priority' AS \"column\", count(DISTINCT priority) AS classes, "
    "CASE WHEN count(DISTINCT priority) < 2 THEN 'too_few' WHEN count(DISTINCT priority) > 100 THEN 'too_many' ELSE 'ok' END AS verdict FROM worn_orders")
add("ml_feature_nulls", report("worn_orders", rd.ml_findings, "classification", "priority", ["FEATURE_NULLS"]), _feature_nulls)
add("ml_constant_features", report("worn_orders", rd.ml_findings, "classification", "priority", ["CONSTANT_FEATURE"]), _constant_features)
_unique = "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count, CAST(count(DISTINCT {c}) AS DOUBLE) / count(*) AS unique_share, count(*) > 10 AND CAST(count(DISTINCT {c}) AS DOUBLE) / count(*) > 0.85 AS is_identifier FROM dirty_customer"
add("ml_id_columns", report("dirty_customer", rd.ml_id_columns), union(["c_name", "c_mktsegment"], _unique))
add("ml_encoding_candidates", report("dirty_customer", rd.ml_encoding_candidates),
    f"SELECT \"column\", unique_count FROM ({union(['c_name', 'c_mktsegment'], _unique)}) WHERE NOT is_identifier AND unique_count <= 20")
_worn_texts = [c for c in WORN_TEXTS if c != "priority"]
_id_points = union(_worn_texts, "SELECT 8.0 AS points, 1 AS finding, 1 AS step FROM (SELECT count(DISTINCT {c}) AS d, count(*) AS n FROM worn_orders) WHERE n > 10 AND CAST(d AS DOUBLE) / n > 0.85")
_encode_steps = union(_worn_texts, "SELECT 0.0, 0, 1 FROM (SELECT count(DISTINCT {c}) AS d, count(*) AS n FROM worn_orders) WHERE NOT (n > 10 AND CAST(d AS DOUBLE) / n > 0.85) AND d <= 20")
add("ml_readiness", report("worn_orders", rd.ml_readiness, "classification", "priority"),
    f"WITH found AS (SELECT points, 1 AS finding, 1 AS step FROM ({_target_nulls} UNION ALL {_feature_nulls} UNION ALL {_constant_features}) UNION ALL {_id_points} UNION ALL {_encode_steps} "
    "UNION ALL SELECT 10.0, 1, 0 UNION ALL SELECT 5.0, 1, 1 UNION ALL SELECT CASE WHEN d < 2 THEN 30.0 WHEN d > 100 THEN 20.0 ELSE 0.0 END, CASE WHEN d < 2 OR d > 100 THEN 1 ELSE 0 END, 0 "
    "FROM (SELECT count(DISTINCT priority) AS d FROM worn_orders)), "
    f"open AS (SELECT count(*) AS u FROM ({_target_nulls})), total AS (SELECT greatest(0.0, least(100.0, round(100.0 - sum(points), 1))) AS s, CAST(sum(finding) AS BIGINT) AS f, CAST(sum(step) AS BIGINT) AS r FROM found) "
    "SELECT 'classification' AS task_type, 'priority' AS target_column, CAST(s AS DOUBLE) AS readiness_score, "
    "CASE WHEN s >= 80 AND u = 0 THEN 'ready' WHEN s >= 50 THEN 'needs_attention' ELSE 'not_ready' END AS overall_status, f AS findings, r AS recommendations, u AS unresolved FROM total, open")
_step = "SELECT {at} AS place, '{operation}' AS operation, '{params}' AS params_json FROM (SELECT count(*) AS n, count({c}) AS k, count(DISTINCT {c}) AS d FROM worn_orders) WHERE {test}"
_is_id = "(n > 10 AND CAST(d AS DOUBLE) / n > 0.85)"
_steps = [_step.format(at=0, operation="drop_missing", params='{"columns": ["priority"], "how": "any"}', c="priority", test="k < n")]
for _at, _c in enumerate(("o_custkey", "o_orderstatus", "price", "customer_text", "day_text", "constant_text", "constant_number")):
    _fill = WORN_FEATURES[_c]
    _value = "" if _c in WORN_NUMBERS else ', "value": "Unknown"'
    _steps.append(_step.format(at=4 * _at + 1, operation=_fill, params=f'{{"columns": ["{_c}"]{_value}}}', c=_c, test="k < n"))
    _steps.append(_step.format(at=4 * _at + 2, operation="drop_column", params=f'{{"columns": ["{_c}"]}}', c=_c, test="d <= 1"))
    if _c in _worn_texts:
        _steps.append(_step.format(at=4 * _at + 3, operation="drop_column", params=f'{{"columns": ["{_c}"]}}', c=_c, test=_is_id))
        _steps.append(_step.format(at=4 * _at + 4, operation="one_hot_encode", params=f'{{"columns": ["{_c}"], "drop_first": true}}', c=_c, test=f"NOT {_is_id} AND d <= 20"))
_steps.append("SELECT 1000, 'train_test_split', '{\"test_size\": 0.2, \"random_state\": 42}'")
add("ml_recommendations", report("worn_orders", rd.ml_recommendations, "classification", "priority"),
    f"SELECT row_number() OVER (ORDER BY place) AS step, operation, params_json FROM ({' UNION ALL '.join(_steps)})")
