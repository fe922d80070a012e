"""Queries that read and write files, keep versions and run streams.

Every query first derives files or versions from the given tables, in the shared scratch
folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwright.operators.filters import FilterRows
from tabwright.operators.scale import HandleOutliers
from tabwright.plans.registry import add
from tabwright.plans.views import table, view
from tabwright.plans.report_queries import WORN
from tabwright.session import scratch_dir
from tabwright.sources import readers, writers
from tabwright.sources.versions import VersionedTable, fingerprint
from tabwright.streaming.stream import accumulate_stream, apply_to_stream, profile_stream, stream_duplicates, stream_totals

# Text without line breaks or quotes, numbers, a boolean and null words.
SHIPPED = """
    SELECT event_id, user_id, event_type, value, amount_text, event_id % 2 = 0 AS is_even,
      CASE WHEN event_id % 3 = 0 THEN 'NULL' WHEN event_id % 3 = 1 THEN 'NaN' ELSE 'kept' END AS note FROM {e}"""
COLUMNS = "event_id, user_id, event_type, value, event_id % 2 = 0 AS is_even, CASE WHEN event_id % 3 = 2 THEN 'kept' END AS note"
AMOUNT = "CASE WHEN amount_text <> 'N/A' THEN amount_text END"


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SHIPPED, e=view(spark, sf_dir, "dirty_events"))


def written(format_type: str, make: Callable[[SparkSession, str], DataFrame], **options) -> Callable[[SparkSession, str], str]:
    """Write a derived table in a format and give the path."""
    return lambda spark, sf_dir: writers.export(make(spark, sf_dir), f"{scratch_dir(spark, format_type)}/table.{format_type}", format_type, **options)


# --- scans -------------------------------------------------------------------------
def _read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_table(spark, written("csv", shipped)(spark, sf_dir))


add("read_csv", _read_csv, f"SELECT {COLUMNS}, {AMOUNT} AS amount_text FROM dirty_events")


def _null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.null_tokens(shipped(spark, sf_dir))


_NULL_WORDS = "('', 'NA', 'N/A', 'null', 'NULL', 'None', 'nan', 'NaN')"


def _read_csv_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with line breaks, quotes and commas, through a delimited file and back."""
    docs = table(spark, sf_dir, "documents")
    return readers.read_table(spark, written("csv", lambda *_: docs)(spark, sf_dir))


add("read_csv_multiline", _read_csv_multiline,
    f"SELECT doc_id, CASE WHEN text NOT IN {_NULL_WORDS} THEN text END AS text, CASE WHEN lang NOT IN {_NULL_WORDS} THEN lang END AS lang, "
    f"CASE WHEN source NOT IN {_NULL_WORDS} THEN source END AS source, n_chars FROM documents")


def _read_csv_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with too few and too many cells below a header of three."""
    keys = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("p"))
    kind, key = F.col("o_orderkey") % 3, F.col("o_orderkey").cast("string")
    line = F.when(kind == 0, F.concat_ws(",", key, "p")).when(kind == 1, F.concat_ws(",", key, "p", F.lit("7"), F.lit("beyond"))).otherwise(F.concat_ws(",", key, "p", F.lit("8")))
    path = f"{scratch_dir(spark, 'ragged')}/table.csv"
    # Each part file starts with the header, as Spark's own files do.
    parts = keys.select(F.pmod(F.xxhash64("o_orderkey"), F.lit(8)).alias("part"), line.alias("value"))
    headers = spark.range(8).select(F.col("id").alias("part"), F.lit("key,priority,extra").alias("value"))
    rows = headers.withColumn("at", F.lit(0)).unionByName(parts.withColumn("at", F.lit(1))).repartition(8, "part").sortWithinPartitions("part", "at")
    rows.select("part", "value").write.partitionBy("part").text(path)
    return readers.read_table(spark, path).select("key", "priority", "extra")


add("read_csv_ragged", _read_csv_ragged,
    "SELECT o_orderkey AS key, o_orderpriority AS priority, CAST(CASE o_orderkey % 3 WHEN 1 THEN 7 WHEN 2 THEN 8 END AS BIGINT) AS extra FROM orders")


add("null_tokens", _null_tokens, f"SELECT {COLUMNS}, {AMOUNT} AS amount_text FROM dirty_events")


def _infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.csv(written("csv", shipped)(spark, sf_dir), header=True)
    types = readers.infer_types(readers.null_tokens(raw))
    return spark.createDataFrame(list(types.items()), "column string, data_type string")


add("infer_types", _infer_types,
    "SELECT * FROM (VALUES ('event_id', 'bigint'), ('user_id', 'bigint'), ('event_type', 'string'), ('value', 'double'), ('amount_text', 'string'), "
    "('is_even', 'boolean'), ('note', 'string')) t(\"column\", data_type)")


def _read_csv_permissive(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "event_id bigint, user_id bigint, event_type string, value double, amount_text bigint, is_even boolean, note string"
    return readers.read_csv_permissive(spark, written("csv", shipped)(spark, sf_dir), schema)


add("read_csv_permissive", _read_csv_permissive,
    rf"SELECT {COLUMNS}, CASE WHEN regexp_full_match(amount_text, '[0-9]+') THEN CAST(amount_text AS BIGINT) END AS amount_text FROM dirty_events")
add("read_parquet", lambda spark, sf_dir: readers.read_parquet(spark, f"{sf_dir}/lineitem.parquet"), "SELECT * FROM lineitem")


def _named(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: view(spark, sf_dir, name)


def _read_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with one array of at most fifty thousand objects each."""
    customers = view(spark, sf_dir, "dirty_customer")
    row = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    arrays = customers.groupBy(F.floor(F.col("c_custkey") / F.lit(50_000)).alias("file")).agg(F.concat_ws(",\n", F.collect_list(row)).alias("rows"))
    path = scratch_dir(spark, "json")
    arrays.select("file", F.concat(F.lit("["), "rows", F.lit("]")).alias("value")).write.partitionBy("file").text(path)
    return readers.read_json(spark, f"{path}/file=*")


_CUSTOMER = "c_custkey, c_name, c_acctbal, c_mktsegment, CAST(c_nationkey AS BIGINT) AS c_nationkey"
add("read_json", _read_json_array, f"SELECT {_CUSTOMER} FROM dirty_customer")
add("read_ndjson", lambda spark, sf_dir: readers.read_table(spark, written("json", _named("dirty_customer"))(spark, sf_dir)), f"SELECT {_CUSTOMER} FROM dirty_customer")


def _encoding_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder of documents in UTF-8, one in ISO-8859-1."""
    base = scratch_dir(spark, "encodings")
    # One line per document; the narrower encoding gets the characters that it can hold.
    line = F.regexp_replace("text", "[\\r\\n]+", " ")
    latin = F.regexp_replace(line, "[^\\x{20}-\\x{7e}\\x{a0}-\\x{ff}]", "")
    docs = table(spark, sf_dir, "documents")
    for encoding, held in ((readers.UTF8, line), (readers.FALLBACK_ENCODING, latin)):
        docs.select("doc_id", held.alias("line")).write.csv(f"{base}/{encoding}", encoding=encoding, escape='"')
    found = readers.encoding_audit(spark, base)
    folder = F.regexp_extract("file", "/(UTF-8|ISO-8859-1)/", 1)
    return found.groupBy(folder.alias("folder")).agg(F.sum("lines").alias("lines"), F.max("encoding").alias("encoding_max"), F.min("encoding").alias("encoding_min"), F.sum("invalid_lines").alias("invalid_lines"))


_odd_line = r"regexp_matches(regexp_replace(text, '[\r\n]+', ' ', 'g'), '[\x{a0}-\x{ff}]')"
add("encoding_audit", _encoding_audit,
    f"SELECT 'UTF-8' AS folder, count(*) AS lines, 'UTF-8' AS encoding_max, 'UTF-8' AS encoding_min, CAST(0 AS BIGINT) AS invalid_lines FROM documents "
    f"UNION ALL SELECT 'ISO-8859-1', count(*), 'ISO-8859-1', 'ISO-8859-1', count(CASE WHEN {_odd_line} THEN 1 END) FROM documents")
add("assert_non_empty", lambda spark, sf_dir: readers.assert_non_empty(table(spark, sf_dir, "orders")), "SELECT * FROM orders")
add("table_metadata", lambda spark, sf_dir: readers.table_metadata(table(spark, sf_dir, "customer")),
    "SELECT CAST(p AS BIGINT) AS position, c AS \"column\", t AS data_type, (SELECT count(*) FROM customer) AS row_count, CAST(5 AS BIGINT) AS column_count "
    "FROM (VALUES (0, 'c_custkey', 'bigint'), (1, 'c_name', 'string'), (2, 'c_nationkey', 'int'), (3, 'c_acctbal', 'double'), (4, 'c_mktsegment', 'string')) v(p, c, t)")


# --- exports -----------------------------------------------------------------------
def _export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written("csv", _named("dup_orders"), include_header=False)(spark, sf_dir)
    return spark.read.csv(path, schema=view(spark, sf_dir, "dup_orders").schema)


add("export_csv", _export_csv, "SELECT * FROM dup_orders")
add("export_parquet", lambda spark, sf_dir: readers.read_table(spark, written("parquet", _named("dirty_events"), compression="zstd")(spark, sf_dir)), "SELECT * FROM dirty_events")
add("export_json", lambda spark, sf_dir: readers.read_table(spark, written("json", _named("dup_orders"))(spark, sf_dir)), "SELECT * FROM dup_orders")
add("export_columns", lambda spark, sf_dir: readers.read_table(spark, written("parquet", _named("orders"), columns=["o_orderkey", "o_totalprice"])(spark, sf_dir)),
    "SELECT o_orderkey, o_totalprice FROM orders")


# --- versions ----------------------------------------------------------------------
def _versioned(spark: SparkSession, sf_dir: str, last: int = 4) -> VersionedTable:
    """Version 1 as given, 2 without incomplete rows, 3 with amounts as integers, 4 a branch of 1."""
    store = VersionedTable(spark, scratch_dir(spark, "versions"))
    store.create(view(spark, sf_dir, "dirty_events"))
    store.apply("drop_missing", {"columns": ["value"]})
    if last > 2:
        store.apply("cast_type", {"column": "amount_text", "target_type": "integer"})
    if last > 3:
        store.branch(1, "trial")
    return store


add("version_apply", lambda spark, sf_dir: _versioned(spark, sf_dir, 2).read(2), "SELECT * FROM dirty_events WHERE value IS NOT NULL")


def _version_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _versioned(spark, sf_dir, 3)
    store.restore(2)
    return store.read()


add("version_read", _version_read, "SELECT * FROM dirty_events WHERE value IS NOT NULL")


def _version_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versioned(spark, sf_dir).versions().select("version_number", "branch_name", "parent_version", "row_count", "column_count", "operation")


add("version_list", _version_list,
    "WITH n AS (SELECT count(*) AS a, count(value) AS k FROM dirty_events) "
    "SELECT CAST(v AS BIGINT) AS version_number, b AS branch_name, CAST(p AS BIGINT) AS parent_version, CASE WHEN v IN (2, 3) THEN k ELSE a END AS row_count, "
    "CAST(8 AS BIGINT) AS column_count, o AS operation FROM n, (VALUES (1, 'main', NULL, 'upload'), (2, 'main', 1, 'drop_missing'), (3, 'main', 2, 'cast_type'), "
    "(4, 'trial', 1, 'branch')) t(v, b, p, o)")
_clean_long = r"regexp_full_match(replace(replace(amount_text, '$', ''), ',', ''), '[0-9]+')"
add("version_compare", lambda spark, sf_dir: _versioned(spark, sf_dir, 3).compare(1, 3),
    "SELECT 'row_count' AS kind, CAST(NULL AS VARCHAR) AS \"column\", CAST(count(*) AS VARCHAR) AS old_value, CAST(count(value) AS VARCHAR) AS new_value, count(value) - count(*) AS diff FROM dirty_events "
    "UNION ALL SELECT 'column_count', NULL, '8', '8', 0 UNION ALL SELECT 'type_changed', 'amount_text', 'string', 'bigint', NULL "
    "UNION ALL SELECT 'null_count', 'value', CAST(count(*) - count(value) AS VARCHAR), '0', count(value) - count(*) FROM dirty_events "
    "UNION ALL SELECT 'null_count', 'event_type', CAST(a AS VARCHAR), CAST(b AS VARCHAR), b - a FROM (SELECT count(*) - count(event_type) AS a, "
    "count(CASE WHEN event_type IS NULL AND value IS NOT NULL THEN 1 END) AS b FROM dirty_events) WHERE a <> b "
    f"UNION ALL SELECT 'null_count', 'amount_text', '0', CAST(b AS VARCHAR), b FROM (SELECT count(CASE WHEN value IS NOT NULL AND NOT {_clean_long} THEN 1 END) AS b FROM dirty_events)")


def _version_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _versioned(spark, sf_dir, 3)
    try:
        store.apply("drop_column", {"columns": ["nowhere"]}, version=1)
    except ValueError:
        pass  # the failed run is what the log should show
    return store.runs().select("source_version", "target_version", "operation", "status", F.get_json_object("summary_json", "$.rows_after").cast("bigint").alias("rows_after"))


add("version_runs", _version_runs,
    "SELECT CAST(1 AS BIGINT) AS source_version, CAST(2 AS BIGINT) AS target_version, 'drop_missing' AS operation, 'completed' AS status, count(value) AS rows_after FROM dirty_events "
    "UNION ALL SELECT 2, 3, 'cast_type', 'completed', count(value) FROM dirty_events UNION ALL SELECT 1, NULL, 'drop_column', 'failed', NULL")
_ITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
_cells = " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in _ITEM)
add("version_fingerprint", lambda spark, sf_dir: fingerprint(table(spark, sf_dir, "lineitem")),
    f"SELECT count(*) AS row_count, bit_xor(CAST('0x' || substring(d, 1, 15) AS BIGINT)) AS hash_xor, CAST(sum(CAST('0x' || substring(d, 17, 15) AS BIGINT)) AS VARCHAR) AS hash_sum "
    f"FROM (SELECT md5({_cells}) AS d FROM lineitem)")


def _version_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations of version 3, run again on the source."""
    return _versioned(spark, sf_dir, 3).replay(view(spark, sf_dir, "dirty_events"), 3)


add("version_replay", _version_replay,
    "SELECT event_id, ts, user_id, event_type, value, "
    f"CASE WHEN {_clean_long} THEN CAST(replace(replace(amount_text, '$', ''), ',', '') AS BIGINT) END AS amount_text, flag_text, constant_text "
    "FROM dirty_events WHERE value IS NOT NULL")


# --- streams -----------------------------------------------------------------------
def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")


def _profile_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_dir(spark, "profile")
    profile_stream(_event_stream(spark, sf_dir), out, scratch_dir(spark, "checkpoint")).awaitTermination()
    rows = spark.read.parquet(out)
    return rows.groupBy("column").agg(F.sum("missing_count").alias("missing_count"))


add("profile_stream", _profile_stream,
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count FROM events" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")))


def _accumulated(spark: SparkSession, sf_dir: str) -> str:
    """The state of a stream of several micro-batches: a table in three files, one read at a time."""
    rows, state = view(spark, sf_dir, "worn_orders"), scratch_dir(spark, "state")
    source = scratch_dir(spark, "arriving")
    rows.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    accumulate_stream(stream, state, scratch_dir(spark, "checkpoint")).awaitTermination()
    return state


add("stream_totals", lambda spark, sf_dir: stream_totals(spark, _accumulated(spark, sf_dir)), " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS count, count(*) - count({c}) AS missing_count, avg({c}) AS mean, stddev_pop({c}) AS std, "
    f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM worn_orders" for c in ("o_custkey", "price", "constant_number")))
add("stream_duplicates", lambda spark, sf_dir: stream_duplicates(spark, _accumulated(spark, sf_dir)),
    "SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_count FROM (SELECT count(*) AS n FROM worn_orders GROUP BY " + ", ".join(WORN) + ")")


def _transform_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences fitted on the table, a filter, and both applied to the stream."""
    clip = HandleOutliers(["value"])
    fitted = clip.fit(table(spark, sf_dir, "events"))
    kept = apply_to_stream(_event_stream(spark, sf_dir), FilterRows("event_type", "!=", "error"))
    out, checkpoint = scratch_dir(spark, "stream"), scratch_dir(spark, "checkpoint")
    apply_to_stream(kept, clip, fitted).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


add("transform_stream", _transform_stream,
    "SELECT event_id, ts, user_id, event_type, CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END AS value, props FROM events, "
    "(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)) "
    "WHERE event_type <> 'error'")
