"""Operation names and the wrapper that runs one on a table."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, functions as F

from tabwright.operators.base import Fitted, Transform
from tabwright.operators.cast import CastType
from tabwright.operators.dates import ParseDates
from tabwright.operators.dedup import RemoveDuplicates, SortRows
from tabwright.operators.encode import OneHotEncode, OrdinalEncode
from tabwright.operators.filters import DropMissing, FilterRows
from tabwright.operators.impute import FillConstant, FillStatistic, fill_missing
from tabwright.operators.projection import DropColumn, DuplicateColumn, RenameColumn, SelectColumns
from tabwright.operators.scale import HandleOutliers, LogTransform, MinMaxScale, StandardScale
from tabwright.operators.split import TrainTestSplit
from tabwright.operators.text_ops import ChangeCase, NormalizeStrings, ReplaceText, TrimWhitespace

OPERATIONS: dict[str, Callable[..., Transform]] = {
    "drop_missing": DropMissing,
    "fill_missing": fill_missing,
    "fill_missing_constant": FillConstant,
    "fill_missing_mean": lambda **p: FillStatistic("mean", **p),
    "fill_missing_median": lambda **p: FillStatistic("median", **p),
    "fill_missing_mode": lambda **p: FillStatistic("mode", **p),
    "remove_duplicates": RemoveDuplicates,
    "drop_duplicates": RemoveDuplicates,
    "cast_type": CastType,
    "rename_column": RenameColumn,
    "drop_column": DropColumn,
    "select_columns": SelectColumns,
    "duplicate_column": DuplicateColumn,
    "trim_whitespace": TrimWhitespace,
    "change_case": ChangeCase,
    "replace_text": ReplaceText,
    "normalize_strings": NormalizeStrings,
    "parse_dates": ParseDates,
    "standard_scale": StandardScale,
    "min_max_scale": MinMaxScale,
    "log_transform": LogTransform,
    "one_hot_encode": OneHotEncode,
    "ordinal_encode": OrdinalEncode,
    "handle_outliers": HandleOutliers,
    "filter_rows": FilterRows,
    "sort_rows": SortRows,
    "train_test_split": TrainTestSplit,
}


def make_transform(operation: str, params: dict[str, Any] | None = None) -> Transform:
    """The transform for an operation name; case, blanks and hyphens in the name do not matter."""
    name = operation.strip().lower().replace(" ", "_").replace("-", "_")
    if name not in OPERATIONS:
        raise ValueError(f"Unknown transformation operation: '{operation}'")
    try:
        return OPERATIONS[name](**(params or {}))
    except TypeError as err:
        raise ValueError(f"Bad parameters for '{operation}': {err}") from err


def fit_transform(df: DataFrame, operation: str, params: dict[str, Any] | None = None) -> tuple[DataFrame, Fitted]:
    """The (lazy) result and the fitted numbers."""
    transform = make_transform(operation, params)
    ready = transform.prepare(df)
    fitted = transform.fit(ready)
    return transform.apply(ready, fitted), fitted


def run_transform(df: DataFrame, operation: str, params: dict[str, Any] | None = None) -> DataFrame:
    return fit_transform(df, operation, params)[0]


def _counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts of two plans in one row, in one job."""
    one = F.count(F.lit(1))
    zero = F.lit(0).cast("bigint")
    first = before.agg(one.alias("rows_before")).select("rows_before", zero.alias("rows_after"))
    second = after.agg(one.alias("rows_after")).select(zero.alias("rows_before"), "rows_after")
    both = first.unionByName(second)
    return both.agg(F.sum("rows_before").alias("rows_before"), F.sum("rows_after").alias("rows_after"))


def transform_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sizes before and after, one row."""
    wide, narrow = len(before.columns), len(after.columns)
    return _counts(before, after).select(
        "rows_before",
        "rows_after",
        F.lit(wide).cast("bigint").alias("columns_before"),
        F.lit(narrow).cast("bigint").alias("columns_after"),
        F.abs(F.col("rows_before") - F.col("rows_after")).alias("rows_affected"),
        F.lit(abs(wide - narrow)).cast("bigint").alias("columns_affected"),
    )
