"""Dry runs: what an operation would do, with nothing stored."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwright.functions.columns import col
from tabwright.operators.cast import CastType, cast_report
from tabwright.operators.dedup import head_sample
from tabwright.operators.dispatch import fit_transform, make_transform, transform_summary

# Fixed value: share of removed rows above which a dry run warns.
LOSS_SHARE = 0.25


@dataclass
class Preview:
    """``report`` has one row; ``warnings`` one row per warning; the samples five rows each."""

    report: DataFrame
    warnings: DataFrame
    sample_before: DataFrame
    sample_after: DataFrame


def _new_nulls(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    def nulls(df: DataFrame, sign: int) -> DataFrame:
        return df.agg((F.count_if(col(column).isNull()) * F.lit(sign)).alias("n"))

    return nulls(before, -1).unionByName(nulls(after, 1)).agg(F.sum("n").alias("new_nulls"))


def _report(before: DataFrame, after: DataFrame, operation: str, message: str | None, counts: dict[str, int] | None = None) -> DataFrame:
    added = [c for c in after.columns if c not in before.columns]
    removed = [c for c in before.columns if c not in after.columns]
    sizes = transform_summary(before, after)
    lost = F.col("rows_before") - F.col("rows_after")
    empty = F.col("rows_after") == 0
    valid, invalid = ((counts or {}).get(k) for k in ("valid_count", "invalid_count"))
    loss = ~empty & (lost > F.col("rows_before") * F.lit(LOSS_SHARE)) & (lost > 0)
    return sizes.select(
        F.lit(operation).alias("operation"),
        "rows_before", "rows_after", "columns_before", "columns_after",
        F.col("rows_affected").alias("affected_row_count"),
        F.col("columns_affected").alias("affected_column_count"),
        F.lit(",".join(added)).alias("columns_added"),
        F.lit(",".join(removed)).alias("columns_removed"),
        empty.alias("is_empty_result"),
        loss.alias("is_data_loss"),
        F.lit(valid).cast("bigint").alias("valid_count"),
        F.lit(invalid).cast("bigint").alias("invalid_count"),
        (empty | loss | F.lit(bool(removed or invalid))).alias("is_potentially_destructive"),
        (F.lit(message is None) & ~empty).alias("validation_passed"),
        F.when(F.lit(message is not None), F.lit(message or "")).when(empty, "Operation drops 100% of rows.").otherwise("").alias("validation_message"),
    )


def destructive_check(before: DataFrame, after: DataFrame, operation: str, params: dict[str, Any]) -> DataFrame:
    """Warning rows ``(code, affected)``; no row when nothing is lost."""
    spark: SparkSession = before.sparkSession
    sizes = transform_summary(before, after)
    lost = F.col("rows_before") - F.col("rows_after")
    rows = sizes.select(
        F.when(F.col("rows_after") == 0, "EMPTY_RESULT")
        .when((lost > 0) & (lost > F.col("rows_before") * F.lit(LOSS_SHARE)), "HIGH_DATA_LOSS").alias("code"),
        lost.alias("affected"),
    ).filter(F.col("code").isNotNull())
    removed = [c for c in before.columns if c not in after.columns]
    if removed:
        rows = rows.unionByName(spark.createDataFrame([("COLUMNS_REMOVED", len(removed))], "code string, affected bigint"))
    column = params.get("column")
    if operation.strip().lower() == "cast_type" and column in after.columns:
        nulls = _new_nulls(before, after, column).filter("new_nulls > 0")
        rows = rows.unionByName(nulls.select(F.lit("CAST_TO_NULL").alias("code"), F.col("new_nulls").alias("affected")))
    return rows


def conversion_counts(df: DataFrame, operation: str, params: dict[str, Any]) -> dict[str, int] | None:
    """How many values a type conversion can and cannot read; None for other operations."""
    cast = make_transform(operation, params)
    return cast_report(df, cast).first().asDict() if isinstance(cast, CastType) else None


def preview(df: DataFrame, operation: str, params: dict[str, Any] | None = None, order_by: list[str] | None = None) -> Preview:
    """Dry run of an operation. A failing one yields a report whose "after" equals its "before"."""
    params = params or {}
    sample_before = head_sample(df, order_by)
    try:
        after, _ = fit_transform(df, operation, params)
        counts = conversion_counts(df, operation, params)
    except Exception as err:  # the report carries any failure to the caller
        nothing = df.sparkSession.createDataFrame([], "code string, affected bigint")
        return Preview(_report(df, df, operation, str(err)), nothing, sample_before, sample_before)
    keys = [c for c in order_by or [] if c in after.columns]
    return Preview(_report(df, after, operation, None, counts), destructive_check(df, after, operation, params), sample_before, head_sample(after, keys))
