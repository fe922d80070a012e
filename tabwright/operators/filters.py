"""Row filters."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabwright.functions.columns import (
    INFINITY, as_list, as_text, col, dtype, finite, is_date, is_float, is_integer, normalize_non_finite, require_columns,
)
from tabwright.operators.base import Fitted, Transform

COMPARISONS = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
}


def typed_literal(value: Any, t: T.DataType) -> Column:
    """The value as a literal of the column's type, so that the comparison can be pushed
    to the file scan. A value that does not convert is an error."""
    try:
        if is_integer(t):
            return F.lit(int(value))
        if is_float(t):
            return F.lit(float(value))
        if isinstance(t, T.DecimalType):
            return F.lit(str(value)).cast(t)
        if isinstance(t, T.BooleanType):
            return F.lit(str(value).lower() in ("true", "1"))
        if isinstance(t, T.DateType):
            return F.lit(dt.date.fromisoformat(str(value)[:10]))
        if is_date(t):
            return F.lit(dt.datetime.fromisoformat(str(value)).isoformat(sep=" ")).cast(t)
        if value is None:
            raise ValueError("there is no value to compare with")
        return F.lit(str(value))
    except (TypeError, ValueError) as err:
        raise ValueError(f"{value!r} is not comparable with {t.simpleString()} values: {err}") from err


@dataclass(frozen=True)
class FilterRows(Transform):
    column: str | None = None
    operator: str = "=="
    value: Any = None

    def prepare(self, df: DataFrame) -> DataFrame:
        # The predicate reads the stored column, not a normalised one, so that it reaches
        # the scan; non-finite floats are ruled out by range tests that also push down.
        return df

    def apply(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        if not self.column:
            raise ValueError("filter_rows: no column was given")
        require_columns(df, [self.column])
        return normalize_non_finite(df.filter(self.predicate(dtype(df, self.column))))

    def predicate(self, t: T.DataType) -> Column:
        c = col(self.column)
        if self.operator in COMPARISONS:
            test = COMPARISONS[self.operator](c, typed_literal(self.value, t))
            # NaN sorts above infinity, so the two range tests drop NaN as well.
            return (c > F.lit(-INFINITY)) & (c < F.lit(INFINITY)) & test if is_float(t) else test
        if self.operator == "contains":
            return finite(self.column, t).cast("string").rlike(str(self.value))
        if self.operator == "is_not_null":
            return (c > F.lit(-INFINITY)) & (c < F.lit(INFINITY)) if is_float(t) else c.isNotNull()
        if self.operator == "is_null":
            return finite(self.column, t).isNull()
        raise ValueError(f"filter_rows knows no operator {self.operator!r}")


@dataclass(frozen=True)
class DropMissing(Transform):
    columns: list[str] | str = field(default_factory=list)
    how: str = "any"

    def apply(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        names = as_list(self.columns) or df.columns
        require_columns(df, names)
        present = [col(c).isNotNull() for c in names]
        if self.how == "all":
            return df.filter(reduce(lambda a, b: a | b, present))
        return df.filter(reduce(lambda a, b: a & b, present))


def search_rows(df: DataFrame, term: str) -> DataFrame:
    """Rows with the term, ignoring case, in the text form of any cell."""
    df = normalize_non_finite(df)
    needle = F.lit(term.lower())
    hits = [F.coalesce(F.contains(F.lower(as_text(f.name, f.dataType)), needle), F.lit(False)) for f in df.schema]
    return df.filter(reduce(lambda a, b: a | b, hits))
