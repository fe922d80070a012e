"""Dirty views of the given tables, written once for Spark and for the checking SQL.

The given tables hold no missing values, so queries run on these projections of whole
tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS = {
    "dirty_events": """
        SELECT event_id, ts, user_id,
          CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type,
          CASE WHEN event_id % 7 = 0 THEN NULL
               WHEN event_id % 101 = 0 THEN value * 50 ELSE value END AS value,
          CASE WHEN event_id % 13 = 0 THEN 'N/A'
               WHEN event_id % 5 = 0 THEN concat('$', CAST(user_id AS VARCHAR(20)), ',000')
               WHEN event_id % 17 = 0 THEN 'bad' ELSE CAST(user_id AS VARCHAR(20)) END AS amount_text,
          CASE WHEN event_id % 4 = 0 THEN 'yes' WHEN event_id % 4 = 1 THEN 'F'
               WHEN event_id % 4 = 2 THEN ' TRUE ' ELSE 'maybe' END AS flag_text,
          'x' AS constant_text
        FROM {events}""",
    "spiky_events": """
        SELECT event_id, event_type,
          CASE WHEN event_id % 19 = 0 THEN CAST('NaN' AS DOUBLE)
               WHEN event_id % 23 = 0 THEN CAST('Infinity' AS DOUBLE)
               WHEN event_id % 29 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE value END AS value
        FROM {events}""",
    "dirty_customer": """
        SELECT c_custkey,
          concat('  ', c_name, CASE WHEN c_custkey % 3 = 0 THEN '   x ' ELSE ' ' END) AS c_name,
          CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
          CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
          c_nationkey
        FROM {customer}""",
    "dup_orders": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM {orders}
        UNION ALL
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM {orders} WHERE o_orderkey % 20 = 0""",
    "worn_orders": """
        SELECT o_custkey, o_orderstatus,
          CASE WHEN o_orderkey % 10 < 4 THEN NULL
               WHEN o_orderkey % 101 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS price,
          CASE WHEN o_orderkey % 10 < 7 THEN NULL ELSE o_orderpriority END AS priority,
          CASE WHEN o_orderkey % 4 = 0 THEN 'Unknown' ELSE concat('$', CAST(o_custkey AS VARCHAR(20))) END AS customer_text,
          substring(CAST(o_orderdate AS VARCHAR(30)), 1, 10) AS day_text,
          'x' AS constant_text, 7 AS constant_number
        FROM {orders}
        UNION ALL
        SELECT o_custkey, o_orderstatus,
          CASE WHEN o_orderkey % 10 < 4 THEN NULL
               WHEN o_orderkey % 101 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS price,
          CASE WHEN o_orderkey % 10 < 7 THEN NULL ELSE o_orderpriority END AS priority,
          CASE WHEN o_orderkey % 4 = 0 THEN 'Unknown' ELSE concat('$', CAST(o_custkey AS VARCHAR(20))) END AS customer_text,
          substring(CAST(o_orderdate AS VARCHAR(30)), 1, 10) AS day_text,
          'x' AS constant_text, 7 AS constant_number
        FROM {orders} WHERE o_orderkey % 4 = 0""",
    "date_text_orders": """
        SELECT o_orderkey,
          CASE WHEN o_orderkey % 6 = 0 THEN 'invalid'
               ELSE substring(CAST(o_orderdate AS VARCHAR(30)), 1, 10) END AS order_day
        FROM {orders}""",
    "day_first_orders": """
        SELECT o_orderkey,
          CASE WHEN o_orderkey % 6 = 0 THEN 'invalid'
               ELSE concat(substring(CAST(o_orderdate AS VARCHAR(30)), 9, 2), '/', substring(CAST(o_orderdate AS VARCHAR(30)), 6, 2),
                           '/', substring(CAST(o_orderdate AS VARCHAR(30)), 1, 4)) END AS order_day
        FROM {orders}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a given table."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    sources = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{t: table(spark, sf_dir, t) for t in sources})


def with_views(sql: str) -> str:
    """The SQL with the derived views it names as leading common table expressions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    ctes = ", ".join(f"{v} AS ({VIEWS[v].format(**{t: t for t in TABLES})})" for v in used)
    body = sql.strip()
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"
