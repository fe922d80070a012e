"""Filling missing values."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabwright.functions.columns import as_list, col, dtype, is_float, is_integer, is_numeric, replace_columns, require_columns
from tabwright.functions.text import parse_boolean_word
from tabwright.operators.base import Fitted, Transform
from tabwright.operators.quantiles import exact_quantiles


def typed_value(column: str, t: T.DataType, value: Any) -> Column:
    """The constant in the column's type; a number or boolean that does not fit is an error."""
    try:
        if is_integer(t):
            return F.lit(int(value)).cast(t)
        if is_float(t):
            return F.lit(float(value)).cast(t)
        if isinstance(t, T.DecimalType):
            return F.lit(str(float(value))).cast(t)
    except (TypeError, ValueError) as err:
        raise ValueError(f"{value!r} is no {t.simpleString()} value to fill {column!r} with: {err}") from err
    if isinstance(t, T.BooleanType):
        parsed = parse_boolean_word(value)
        if parsed is None:
            raise ValueError(f"{value!r} is no boolean value to fill {column!r} with")
        return F.lit(parsed)
    return F.lit(str(value)).cast(t)


@dataclass(frozen=True)
class FillConstant(Transform):
    columns: list[str] | str = field(default_factory=list)
    value: Any = None

    def apply(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        names = as_list(self.columns)
        if not names:
            raise ValueError("fill_missing_constant: no columns were given")
        require_columns(df, names)
        return replace_columns(df, {c: F.coalesce(col(c), typed_value(c, dtype(df, c), self.value)) for c in names})


def column_modes(df: DataFrame, columns: list[str]) -> dict[str, Any]:
    """The most frequent value of each column, the smallest one on a tie.

    All columns of one type are counted in one job. Counting by value shuffles one row per task
    and value; keeping the values of a column in one aggregation buffer, as ``mode`` does, would
    not hold for identifier columns.
    """
    kinds: dict[str, list[int]] = {}
    for i, c in enumerate(columns):
        kinds.setdefault(dtype(df, c).simpleString(), []).append(i)
    found = dict.fromkeys(columns)
    for own in kinds.values():
        cells = F.array(*[F.struct(F.lit(i).alias("i"), col(columns[i]).alias("value")) for i in own])
        counts = df.select(F.inline(cells)).filter("value IS NOT NULL").groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"))
        for r in counts.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("top")).collect():
            found[columns[r["i"]]] = r["top"]["value"]
    return found


@dataclass(frozen=True)
class FillStatistic(Transform):
    statistic: str = "mean"
    columns: list[str] | str = field(default_factory=list)

    def fit(self, df: DataFrame) -> Fitted:
        names = as_list(self.columns)
        if not names:
            raise ValueError(f"fill_missing_{self.statistic}: no columns were given")
        require_columns(df, names)
        if self.statistic == "mode":
            values = column_modes(df, names)
        else:
            wrong = [c for c in names if not is_numeric(dtype(df, c))]
            if wrong:
                raise ValueError(f"non-numeric {wrong[0]!r} has no {self.statistic}")
            if self.statistic == "mean":
                row = df.agg(*[F.avg(col(c)).cast("double").alias(f"m{i}") for i, c in enumerate(names)]).first()
                values = {c: row[f"m{i}"] for i, c in enumerate(names)}
            else:
                values = {c: q[0] for c, q in exact_quantiles(df, names, [0.5]).items()}
        # A column without values has no statistic and stays as it is.
        return {"filled_values": {c: v for c, v in values.items() if v is not None}}

    def apply(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        changed = {}
        for c, v in fitted["filled_values"].items():
            if self.statistic == "mode":
                changed[c] = F.coalesce(col(c), F.lit(v).cast(dtype(df, c)))
            else:
                changed[c] = F.coalesce(col(c).cast("double"), F.lit(float(v)))
        return replace_columns(df, changed)


def fill_missing(strategy: str = "mean", **params: Any) -> Transform:
    """The filling transform for a strategy name."""
    if strategy == "constant":
        return FillConstant(**params)
    if strategy not in ("mean", "median", "mode"):
        raise ValueError("fill_missing: known strategies are mean, median, mode and constant")
    params.pop("value", None)
    return FillStatistic(strategy, **params)
