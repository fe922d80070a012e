"""Queries for projections, filters, deduplication, filling, casting, text, dates, scaling,
encoding, splitting and dry runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwright.functions.columns import normalize_non_finite
from tabwright.functions.text import clean_numeric_text
from tabwright.operators.cast import CastType, cast_report
from tabwright.operators.dedup import duplicate_count, head_sample, page_info, page_rows
from tabwright.operators.dispatch import run_transform, transform_summary
from tabwright.operators.filters import search_rows
from tabwright.operators.preview import destructive_check, preview
from tabwright.plans.registry import add, report, transform
from tabwright.plans.views import view

EVENTS = "event_id, ts, user_id, event_type, value, amount_text, flag_text, constant_text"
SPACE = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
MISSING = "('', 'na', 'n/a', 'null', 'none', 'nan', 'unknown', 'undefined', '-', '--')"


def cleaned(c: str) -> str:
    """Checking SQL for numeric text without signs and unit words."""
    bare = (
        f"trim(regexp_replace(regexp_replace(trim({c}, {SPACE}), '[,$€£%]', '', 'g'), "
        rf"'(?i)\b(?:year|years|yr|yrs|annual|salary|usd|eur|gbp)\b', '', 'g'), {SPACE})"
    )
    number = r"'[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?'"
    return f"CASE WHEN lower(trim({c}, {SPACE})) NOT IN {MISSING} AND regexp_full_match({bare}, {number}) THEN {bare} END"


def swapped(columns: str, **changed: str) -> str:
    """The column list with some columns replaced by expressions."""
    return ", ".join(f"{changed[c]} AS {c}" if c in changed else c for c in columns.split(", "))


# --- projections -------------------------------------------------------------------
add("rename_column", transform("orders", "rename_column", mapping={"o_orderkey": "order_id", "o_totalprice": "price"}),
    "SELECT o_orderkey AS order_id, o_custkey, o_orderstatus, o_totalprice AS price, o_orderdate, o_orderpriority FROM orders")
add("drop_column", transform("orders", "drop_column", columns=["o_orderdate", "o_orderpriority"]),
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
add("select_columns", transform("orders", "select_columns", columns=["o_orderkey", "o_totalprice"]),
    "SELECT o_orderkey, o_totalprice FROM orders")
add("duplicate_column", transform("orders", "duplicate_column", source_column="o_totalprice", new_column="price_copy"),
    "SELECT *, o_totalprice AS price_copy FROM orders")
add("normalize_non_finite", report("spiky_events", normalize_non_finite),
    "SELECT event_id, event_type, CASE WHEN isnan(value) OR isinf(value) THEN NULL ELSE value END AS value FROM spiky_events")

# --- filters -----------------------------------------------------------------------
_compare = {"eq": ("==", "="), "ne": ("!=", "<>")}
for _name, (_operator, _sql) in _compare.items():
    add(f"filter_{_name}", transform("dirty_events", "filter_rows", column="event_type", operator=_operator, value="click"),
        f"SELECT * FROM dirty_events WHERE event_type {_sql} 'click'")
for _name, _operator in {"gt": ">", "ge": ">=", "lt": "<", "le": "<="}.items():
    add(f"filter_{_name}", transform("dirty_events", "filter_rows", column="value", operator=_operator, value="12.31"),
        f"SELECT * FROM dirty_events WHERE value {_operator} 12.31")
add("filter_contains", transform("dirty_events", "filter_rows", column="amount_text", operator="contains", value=r"^\$1.*0$"),
    r"SELECT * FROM dirty_events WHERE regexp_matches(amount_text, '^\$1.*0$')")
add("filter_is_not_null", transform("spiky_events", "filter_rows", column="value", operator="is_not_null"),
    "SELECT * FROM spiky_events WHERE NOT isnan(value) AND NOT isinf(value)")
add("filter_is_null", transform("dirty_events", "filter_rows", column="value", operator="is_null"),
    "SELECT * FROM dirty_events WHERE value IS NULL")
add("drop_missing_any", transform("dirty_events", "drop_missing"),
    "SELECT * FROM dirty_events WHERE event_type IS NOT NULL AND value IS NOT NULL")
add("drop_missing_all", transform("dirty_events", "drop_missing", columns=["event_type", "value"], how="all"),
    "SELECT * FROM dirty_events WHERE event_type IS NOT NULL OR value IS NOT NULL")
add("search_rows", report("dirty_customer", search_rows, "BUILD"),
    "SELECT * FROM dirty_customer WHERE contains(lower(c_name), 'build') OR coalesce(contains(lower(c_mktsegment), 'build'), false)")

# --- deduplication, sorting, paging ------------------------------------------------
ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
add("remove_duplicates", transform("dup_orders", "remove_duplicates"), "SELECT DISTINCT * FROM dup_orders")
add("drop_duplicates", transform("dup_orders", "drop_duplicates", subset=["o_orderkey"], order_by=["o_orderkey"]),
    "SELECT DISTINCT * FROM dup_orders")
for _keep, _direction in {"first": "ASC", "last": "DESC"}.items():
    add(f"dedup_subset_{_keep}", transform("dup_orders", "remove_duplicates", subset=["o_custkey", "o_orderstatus"], keep=_keep, order_by=["o_orderkey"]),
        f"SELECT {ORDERS} FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey {_direction}) AS rn FROM dup_orders) WHERE rn = 1")
add("duplicate_count", report("dup_orders", duplicate_count),
    "SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_count "
    f"FROM (SELECT count(*) AS n FROM dup_orders GROUP BY {ORDERS})")
add("sort_rows", transform("dirty_events", "sort_rows", columns=["event_type", "value"], descending=True),
    "SELECT * FROM dirty_events ORDER BY event_type DESC NULLS FIRST, value DESC NULLS FIRST")
add("page_rows", report("orders", page_rows, 7, 50, ["o_orderpriority", "o_orderkey"]),
    "SELECT * FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 50 OFFSET 300")
add("page_rows_deep", report("lineitem", page_rows, 701, 50, ["l_shipdate", "l_orderkey", "l_linenumber"]),
    "SELECT * FROM lineitem ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax LIMIT 50 OFFSET 35000")


def _page_by_array(spark, sf_dir):
    """A page in the order of whole vectors."""
    return page_rows(view(spark, sf_dir, "embeddings"), 3, 40, ["embedding"]).select("vec_id", "label")


add("page_rows_nested", _page_by_array, "SELECT vec_id, label FROM embeddings ORDER BY embedding, vec_id LIMIT 40 OFFSET 80")
# Beyond the first rows, pages are found by exact selection, here within arrays and structs.
add("page_rows_nested_deep", lambda spark, sf_dir: page_rows(
    view(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "array(o_custkey % 50, o_orderkey % 7) AS bag", "named_struct('s', o_orderstatus, 'p', o_orderpriority) AS pair"),
    120, 100, ["bag", "pair", "o_orderkey"]).select("o_orderkey", "o_custkey"),
    "SELECT o_orderkey, o_custkey FROM orders ORDER BY [o_custkey % 50, o_orderkey % 7], o_orderstatus, o_orderpriority, o_orderkey LIMIT 100 OFFSET 11900")
add("duplicate_count_texts", report("documents", lambda df: duplicate_count(df.select("text", "lang", "source"))),
    "SELECT (SELECT count(*) FROM documents) AS row_count, (SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) AS duplicate_count")
add("head_sample", report("dirty_events", head_sample, ["event_type", "event_id"]),
    "SELECT * FROM dirty_events ORDER BY event_type NULLS FIRST, event_id LIMIT 5")

# --- filling -----------------------------------------------------------------------
add("fill_missing_constant", transform("dirty_events", "fill_missing_constant", columns=["event_type"], value="Unknown"),
    f"SELECT {swapped(EVENTS, event_type="coalesce(event_type, 'Unknown')")} FROM dirty_events")
add("fill_missing_mean", transform("dirty_events", "fill_missing_mean", columns=["value"]),
    f"SELECT {swapped(EVENTS, value='coalesce(value, (SELECT avg(value) FROM dirty_events))')} FROM dirty_events")
add("fill_missing_median", transform("dirty_events", "fill_missing_median", columns=["value"]),
    f"SELECT {swapped(EVENTS, value='coalesce(value, (SELECT quantile_cont(value, 0.5) FROM dirty_events))')} FROM dirty_events")
_mode = "(SELECT event_type FROM dirty_events WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)"
add("fill_missing_mode", transform("dirty_events", "fill_missing_mode", columns=["event_type"]),
    f"SELECT {swapped(EVENTS, event_type=f'coalesce(event_type, {_mode})')} FROM dirty_events")
add("fill_missing", transform("dirty_customer", "fill_missing", columns=["c_acctbal"], strategy="median"),
    "SELECT c_custkey, c_name, coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM dirty_customer)) AS c_acctbal, c_mktsegment, c_nationkey FROM dirty_customer")

# --- casting -----------------------------------------------------------------------
_amount = f"(SELECT *, {cleaned('amount_text')} AS clean FROM dirty_events)"
_long = r"CASE WHEN regexp_full_match(clean, '[+-]?[0-9]+') THEN TRY_CAST(clean AS BIGINT) END"
add("cast_integer", transform("dirty_events", "cast_type", column="amount_text", target_type="integer"),
    f"SELECT {swapped(EVENTS, amount_text=_long)} FROM {_amount}")
add("cast_float", transform("dirty_events", "cast_type", column="amount_text", target_type="float"),
    f"SELECT {swapped(EVENTS, amount_text='TRY_CAST(clean AS DOUBLE)')} FROM {_amount}")
add("cast_string", transform("dirty_events", "cast_type", column="user_id", target_type="text"),
    f"SELECT {swapped(EVENTS, user_id='CAST(user_id AS VARCHAR)')} FROM dirty_events")
_flag = (
    f"CASE WHEN lower(trim(flag_text, {SPACE})) IN ('true', '1', 'yes', 't', 'y') THEN true "
    f"WHEN lower(trim(flag_text, {SPACE})) IN ('false', '0', 'no', 'f', 'n') THEN false END"
)
add("cast_boolean", transform("dirty_events", "cast_type", column="flag_text", target_type="boolean"),
    f"SELECT {swapped(EVENTS, flag_text=_flag)} FROM dirty_events")
add("cast_date", transform("date_text_orders", "cast_type", column="order_day", target_type="date", format="%Y-%m-%d"),
    "SELECT o_orderkey, CAST(try_strptime(order_day, '%Y-%m-%d') AS DATE) AS order_day FROM date_text_orders")
add("cast_datetime", transform("day_first_orders", "cast_type", column="order_day", target_type="datetime", format="%d/%m/%Y"),
    "SELECT o_orderkey, try_strptime(order_day, '%d/%m/%Y') AS order_day FROM day_first_orders")
add("cast_categorical", transform("dirty_events", "cast_type", column="event_type", target_type="categorical"), "SELECT * FROM dirty_events")


def _clean_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "dirty_events").select("event_id", clean_numeric_text(F.col("amount_text")).alias("clean"))


add("clean_numeric_text", _clean_numeric, f"SELECT event_id, {cleaned('amount_text')} AS clean FROM dirty_events")
add("cast_replace_default",
    transform("dirty_events", "cast_type", column="flag_text", target_type="boolean", invalid_strategy="replace_default", default_value="false"),
    f"SELECT {swapped(EVENTS, flag_text=f'coalesce({_flag}, false)')} FROM dirty_events")
add("cast_report", report("dirty_events", cast_report, CastType("amount_text", "integer")),
    "SELECT 'amount_text' AS \"column\", 'string' AS source_type, 'integer' AS target_type, 'coerce_null' AS invalid_strategy, "
    f"count(*) - count({_long}) AS invalid_count, count({_long}) AS valid_count, count(*) - count({_long}) AS new_null_count FROM {_amount}")

# --- text --------------------------------------------------------------------------
CUSTOMER = "c_custkey, c_name, c_acctbal, c_mktsegment, c_nationkey"
add("trim_whitespace", transform("dirty_customer", "trim_whitespace"),
    f"SELECT {swapped(CUSTOMER, c_name='trim(c_name)')} FROM dirty_customer")
for _case, _fn in {"lower": "lower(c_mktsegment)", "upper": "upper(c_mktsegment)", "title": "upper(substring(c_mktsegment, 1, 1)) || lower(substring(c_mktsegment, 2))"}.items():
    add(f"change_case_{_case}", transform("dirty_customer", "change_case", columns=["c_mktsegment"], case=_case),
        f"SELECT {swapped(CUSTOMER, c_mktsegment=_fn)} FROM dirty_customer")
add("replace_text_literal", transform("dirty_events", "replace_text", columns=["amount_text"], pattern="$", replacement="USD "),
    f"SELECT {swapped(EVENTS, amount_text="replace(amount_text, '$', 'USD ')")} FROM dirty_events")
add("replace_text_regex", transform("dirty_customer", "replace_text", columns=["c_name"], pattern="#0*([0-9])", replacement=" no $1", is_regex=True),
    f"SELECT {swapped(CUSTOMER, c_name=r"regexp_replace(c_name, '#0*([0-9])', ' no \1', 'g')")} FROM dirty_customer")
add("normalize_strings", transform("dirty_customer", "normalize_strings", columns=["c_name"]),
    f"SELECT {swapped(CUSTOMER, c_name=r"regexp_replace(trim(c_name), '\s+', ' ', 'g')")} FROM dirty_customer")

# --- dates -------------------------------------------------------------------------
add("parse_dates_format", transform("date_text_orders", "parse_dates", columns=["order_day"], format="%Y-%m-%d"),
    "SELECT o_orderkey, CAST(try_strptime(order_day, '%Y-%m-%d') AS DATE) AS order_day FROM date_text_orders")
add("parse_dates_auto", transform("day_first_orders", "parse_dates", columns=["order_day"]),
    "SELECT o_orderkey, CAST(try_strptime(order_day, '%d/%m/%Y') AS DATE) AS order_day FROM day_first_orders")
for _part, (_column, _sql) in {
    "year": ("year", "year(o_orderdate)"), "month": ("month", "month(o_orderdate)"),
    "day": ("day", "day(o_orderdate)"), "day_of_week": ("weekday", "isodow(o_orderdate)"),
}.items():
    add(f"date_{_column}", transform("orders", "parse_dates", columns=["o_orderdate"], extract_components=[_part]),
        f"SELECT *, CAST({_sql} AS INTEGER) AS o_orderdate_{_column} FROM orders")

# --- scaling and outliers ----------------------------------------------------------
add("standard_scale", transform("dirty_events", "standard_scale", columns=["value"]),
    f"SELECT {swapped(EVENTS, value='(value - s.m) / s.d')} FROM dirty_events, (SELECT avg(value) AS m, stddev_samp(value) AS d FROM dirty_events) s")
add("min_max_scale", transform("dirty_events", "min_max_scale", columns=["value"], min_target=-1, max_target=1),
    f"SELECT {swapped(EVENTS, value='(value - s.a) / (s.b - s.a) * 2.0 + -1.0')} FROM dirty_events, (SELECT min(value) AS a, max(value) AS b FROM dirty_events) s")
add("log_transform", transform("customer", "log_transform", columns=["c_acctbal"]),
    "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal >= 0 THEN ln(1 + c_acctbal) END AS c_acctbal, c_mktsegment FROM customer")


def _fences(source: str, c: str) -> str:
    return (
        f"(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
        f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source}))"
    )


def _sigmas(source: str, c: str) -> str:
    return f"(SELECT avg({c}) - 3.0 * stddev_pop({c}) AS lo, avg({c}) + 3.0 * stddev_pop({c}) AS hi FROM {source})"


_clipped = swapped(EVENTS, value="CASE WHEN value < b.lo THEN b.lo WHEN value > b.hi THEN b.hi ELSE value END")
for _method, _bounds in {"iqr": _fences, "zscore": _sigmas}.items():
    add(f"outliers_{_method}_clip", transform("dirty_events", "handle_outliers", columns=["value"], method=_method, action="clip"),
        f"SELECT {_clipped} FROM dirty_events, {_bounds('dirty_events', 'value')} b")
    add(f"outliers_{_method}_remove", transform("dirty_events", "handle_outliers", columns=["value", "user_id"], method=_method, action="remove"),
        f"WITH kept AS (SELECT e.* FROM dirty_events e, {_bounds('dirty_events', 'value')} b WHERE value IS NULL OR (value >= b.lo AND value <= b.hi)) "
        f"SELECT k.* FROM kept k, {_bounds('kept', 'user_id')} b WHERE user_id >= b.lo AND user_id <= b.hi")

# --- encoding and splitting --------------------------------------------------------
# The event types of the given data.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
_rest = ", ".join(c for c in EVENTS.split(", ") if c != "event_type")


def _flags(names: list[str]) -> str:
    return ", ".join(f"CAST(coalesce(event_type = '{n}', false) AS TINYINT) AS event_type_{n}" for n in names)


add("one_hot_encode", transform("dirty_events", "one_hot_encode", columns=["event_type"], order_by=["event_id"]),
    f"SELECT {_rest}, {_flags(EVENT_TYPES)} FROM dirty_events")
# The words stand in a quarter of the rows each; of equally frequent ones the least are taken.
add("one_hot_frequent", transform("dirty_events", "one_hot_encode", columns=["flag_text"], max_categories=2, pick="frequent", other=True),
    "WITH k AS (SELECT flag_text AS v, row_number() OVER (ORDER BY count(*) DESC, flag_text) AS i FROM dirty_events GROUP BY flag_text) "
    "SELECT e.* EXCLUDE (flag_text), CAST(flag_text = ' TRUE ' AS TINYINT) AS \"flag_text_TRUE\", CAST(flag_text = 'F' AS TINYINT) AS \"flag_text_F\", "
    "CAST(k.i > 2 AS TINYINT) AS flag_text_other FROM dirty_events e JOIN k ON k.v = e.flag_text")
add("one_hot_drop_first", transform("dirty_events", "one_hot_encode", columns=["event_type"], drop_first=True, order_by=["event_type"]),
    f"SELECT {_rest}, {_flags(EVENT_TYPES[1:])} FROM dirty_events")
add("ordinal_encode", transform("dirty_events", "ordinal_encode", column="event_type", order=["view", "click", "purchase"]),
    f"SELECT {swapped(EVENTS, event_type="CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END")} FROM dirty_events")
add("train_test_split", transform("orders", "train_test_split", test_size=0.2, validation_size=0.1, random_state=42, order_by=["o_orderkey"]),
    "WITH sized AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', o_orderkey))) AS rn, count(*) OVER () AS n FROM orders) "
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, "
    "CASE WHEN rn <= n - round_even(n * 0.2, 0) - round_even(n * 0.1, 0) THEN 'train' WHEN rn <= n - round_even(n * 0.2, 0) THEN 'val' ELSE 'test' END "
    "AS split_assignment FROM sized")


# --- dry runs ----------------------------------------------------------------------
def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = view(spark, sf_dir, "dirty_events")
    return transform_summary(before, run_transform(before, "drop_missing"))


add("transform_summary", _summary,
    "SELECT count(*) AS rows_before, count(CASE WHEN event_type IS NOT NULL AND value IS NOT NULL THEN 1 END) AS rows_after, "
    "CAST(8 AS BIGINT) AS columns_before, CAST(8 AS BIGINT) AS columns_after, "
    "count(CASE WHEN event_type IS NULL OR value IS NULL THEN 1 END) AS rows_affected, CAST(0 AS BIGINT) AS columns_affected FROM dirty_events")


def _preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(view(spark, sf_dir, "dirty_events"), "filter_rows", {"column": "value", "operator": ">", "value": 30}, ["event_id"]).report


add("transform_preview", _preview,
    "SELECT 'filter_rows' AS operation, n AS rows_before, k AS rows_after, CAST(8 AS BIGINT) AS columns_before, CAST(8 AS BIGINT) AS columns_after, "
    "n - k AS affected_row_count, CAST(0 AS BIGINT) AS affected_column_count, '' AS columns_added, '' AS columns_removed, k = 0 AS is_empty_result, "
    "k > 0 AND n - k > n * 0.25 AND n > k AS is_data_loss, CAST(NULL AS BIGINT) AS valid_count, CAST(NULL AS BIGINT) AS invalid_count, "
    "k = 0 OR (n - k > n * 0.25 AND n > k) AS is_potentially_destructive, k > 0 AS validation_passed, "
    "CASE WHEN k = 0 THEN 'Operation drops 100% of rows.' ELSE '' END AS validation_message "
    "FROM (SELECT count(*) AS n, count(CASE WHEN value > 30 THEN 1 END) AS k FROM dirty_events)")


def _preview_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(view(spark, sf_dir, "dirty_events"), "cast_type", {"column": "amount_text", "target_type": "integer"}).report.select(
        "operation", "rows_before", "rows_after", "valid_count", "invalid_count", "is_potentially_destructive")


add("transform_preview_cast", _preview_cast,
    "SELECT 'cast_type' AS operation, n AS rows_before, n AS rows_after, k AS valid_count, n - k AS invalid_count, n > k AS is_potentially_destructive FROM "
    "(SELECT count(*) AS n, count(CASE WHEN regexp_full_match(replace(replace(amount_text, '$', ''), ',', ''), '[0-9]+') THEN 1 END) AS k FROM dirty_events)")
add("page_info", report("orders", page_info, 7, 50),
    "SELECT CAST(7 AS BIGINT) AS page, CAST(50 AS BIGINT) AS page_size, count(*) AS total_rows, CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages, "
    "CAST(6 AS BIGINT) AS total_columns, 'o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string' AS types FROM orders")


def _destructive(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = view(spark, sf_dir, "dirty_events")
    params = {"column": "amount_text", "target_type": "integer"}
    kept = run_transform(before, "filter_rows", {"column": "value", "operator": "<", "value": 10})
    rows = destructive_check(before, kept, "filter_rows", {})
    return rows.unionByName(destructive_check(before, run_transform(before, "cast_type", params), "cast_type", params))


add("destructive_check", _destructive,
    "SELECT 'HIGH_DATA_LOSS' AS code, n - k AS affected FROM (SELECT count(*) AS n, count(CASE WHEN value < 10 THEN 1 END) AS k FROM dirty_events) "
    f"WHERE k > 0 AND n - k > n * 0.25 UNION ALL SELECT 'CAST_TO_NULL', count(*) - count({_long}) FROM {_amount} HAVING count(*) > count({_long})")
