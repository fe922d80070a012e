"""Rule-based validation."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame

from tabwright.functions.columns import col, dtype, is_float
from tabwright.operators import facts as fx
from tabwright.operators.facts import TableFacts, percentage

# --- fixed values ------------------------------------------------------------------
RULES = [
    "NON_EMPTY_DATASET", "COLUMN_NAMES_VALIDITY", "NULL_INTEGRITY",
    "DUPLICATE_RECORDS", "NUMERICAL_FINITENESS", "CONSTANT_COLUMNS_CHECK",
]
DUPLICATES_CRITICAL = 10
NULLS_WARNING, NULLS_CRITICAL = 10.0, 50.0
# -----------------------------------------------------------------------------------

SCHEMA = "rule string, severity string, column string, row_count bigint"


def _frame(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def non_empty_rows(table: TableFacts) -> list[tuple]:
    return [("NON_EMPTY_DATASET", "critical", None, 0)] if table.rows == 0 else []


def duplicate_rows(copies: int) -> list[tuple]:
    return [("DUPLICATE_RECORDS", "warning" if copies < DUPLICATES_CRITICAL else "critical", None, copies)] if copies else []


def null_rows(table: TableFacts) -> list[tuple]:
    out = []
    for c in table.columns:
        missing = table.missing(c)
        share = percentage(missing, table.rows, 1)
        if missing:
            out.append(("NULL_INTEGRITY", "critical" if share > NULLS_CRITICAL else "warning" if share > NULLS_WARNING else "info", c, missing))
    return out


def constant_rows(table: TableFacts) -> list[tuple]:
    return [("CONSTANT_COLUMNS_CHECK", "warning", c, table.rows) for c, f in table.columns.items() if f.single and table.rows > 1]


def name_rows(names: list[str]) -> list[tuple]:
    """Empty, blank-padded, repeated or case-colliding names."""
    folded = Counter(n.lower() for n in names)
    bad = [n for n in names if not n.strip() or n != n.strip() or folded[n.lower()] > 1]
    return [("COLUMN_NAMES_VALIDITY", "warning", n, 0) for n in bad]


def finite_rows(table: TableFacts) -> list[tuple]:
    """NaN and infinities of the table as stored."""
    return [("NUMERICAL_FINITENESS", "critical", c, f.non_finite) for c, f in table.columns.items() if f.non_finite]


def validate_non_empty(df: DataFrame) -> DataFrame:
    return _frame(df, [("NON_EMPTY_DATASET", "critical", None, 0)] if df.isEmpty() else [])


def validate_duplicates(df: DataFrame) -> DataFrame:
    return _frame(df, duplicate_rows(fx.duplicates(df)))


def validate_nulls(df: DataFrame) -> DataFrame:
    return _frame(df, null_rows(fx.measure(df, detail=False)))


def validate_constant(df: DataFrame) -> DataFrame:
    return _frame(df, constant_rows(fx.measure(df, detail=False)))


def validate_finite(df: DataFrame) -> DataFrame:
    return _frame(df, finite_rows(fx.measure(df.select(*[col(c) for c in df.columns if is_float(dtype(df, c))]), detail=False)))


def validate_column_names(df: DataFrame) -> DataFrame:
    return _frame(df, name_rows(df.columns))


def all_rows(df: DataFrame) -> list[tuple]:
    table = fx.measure(df, detail=False)
    return [
        *non_empty_rows(table), *name_rows(df.columns), *duplicate_rows(fx.duplicates(df)),
        *null_rows(table), *finite_rows(table), *constant_rows(table),
    ]


def validation_issues(df: DataFrame) -> DataFrame:
    return _frame(df, all_rows(df))


def validation_report(df: DataFrame) -> DataFrame:
    """Overall status and the number of issues, informational ones included."""
    severities = [r[1] for r in all_rows(df)]
    status = "failed" if "critical" in severities else "warning" if "warning" in severities else "passed"
    return df.sparkSession.createDataFrame(
        [(status, len(severities), len(RULES))], "overall_status string, violations_count bigint, rules_checked bigint"
    )
