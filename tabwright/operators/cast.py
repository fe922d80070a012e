"""Type conversion with a choice of what happens to values that do not convert."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabwright.functions.columns import col, dtype, finite, is_date, is_numeric, is_string, normalize_non_finite, replace_columns
from tabwright.functions.dates import DATE_PATTERNS, TIMESTAMP_PATTERNS, parse_date, parse_datetime, spark_pattern
from tabwright.functions.text import parse_boolean_word, text_to_boolean, text_to_double, text_to_long
from tabwright.operators.base import Fitted, Transform

# Target names and the Spark types they stand for.
TARGETS = {
    "integer": "bigint", "float": "double", "string": "string", "text": "string", "boolean": "boolean",
    "date": "date", "datetime": "timestamp_ntz", "categorical": "string", "category": "string",
}
STRATEGIES = ("coerce_null", "replace_default", "raise")
LOGICAL_TYPE = "logical_type"


def best_pattern(df: DataFrame, c: Column, patterns: list[str]) -> str:
    """The candidate pattern most values parse with; the first one wins a tie."""
    row = df.agg(*[F.count(F.try_to_timestamp(c, F.lit(p))).alias(f"n{i}") for i, p in enumerate(patterns)]).first()
    return max(zip(row, [-i for i in range(len(patterns))], patterns))[2]


@dataclass(frozen=True)
class CastType(Transform):
    column: str | None = None
    target_type: str = ""
    invalid_strategy: str = "coerce_null"
    default_value: Any = None
    format: str | None = None

    @property
    def target(self) -> str:
        return self.target_type.lower().strip()

    def check(self, df: DataFrame) -> None:
        if not self.column or self.column not in df.columns:
            raise ValueError(f"cast_type needs a column of the table; {self.column!r} is none")
        if self.target not in TARGETS:
            raise ValueError(f"Unsupported target type {self.target_type!r}; known are {', '.join(TARGETS)}")
        if self.invalid_strategy not in STRATEGIES:
            raise ValueError(f"invalid_strategy is {self.invalid_strategy!r}; known are {', '.join(STRATEGIES)}")

    def fit(self, df: DataFrame) -> Fitted:
        self.check(df)
        t = dtype(df, self.column)
        fitted: Fitted = {"pattern": None}
        if self.target in ("date", "datetime") and not is_date(t):
            if self.format:
                fitted["pattern"] = spark_pattern(self.format)
            else:
                candidates = DATE_PATTERNS if self.target == "date" else TIMESTAMP_PATTERNS + DATE_PATTERNS
                fitted["pattern"] = best_pattern(df, col(self.column).cast("string"), candidates)
        if self.invalid_strategy == "raise":
            bad = df.filter(col(self.column).isNotNull() & self.converted(t, fitted).isNull()).count()
            if bad:
                raise ValueError(f"{bad} values of {self.column!r} do not convert to {self.target}")
        return fitted

    def converted(self, t: T.DataType, fitted: Fitted) -> Column:
        """The value in the target type, null where it does not convert."""
        c, target = finite(self.column, t), self.target
        if target == "integer":
            return text_to_long(c) if is_string(t) else c.try_cast("bigint")
        if target == "float":
            return text_to_double(c) if is_string(t) else c.try_cast("double")
        if target == "boolean":
            if isinstance(t, T.BooleanType):
                return c
            if is_numeric(t):
                return F.when(c == 1, F.lit(True)).when(c == 0, F.lit(False))
            return text_to_boolean(c.cast("string"))
        if target in ("date", "datetime"):
            if is_date(t):
                return c.cast(TARGETS[target])
            parse = parse_date if target == "date" else parse_datetime
            return parse(c.cast("string"), fitted["pattern"])
        return c.cast("string")

    def default(self) -> Column:
        v = self.default_value
        if self.target == "integer":
            return F.lit(int(v)).cast("bigint")
        if self.target == "float":
            return F.lit(float(v))
        if self.target == "boolean":
            parsed = v if isinstance(v, bool) else parse_boolean_word(v)
            if parsed is None:
                raise ValueError(f"default_value {self.default_value!r} stands for neither true nor false")
            return F.lit(parsed)
        if self.target == "date":
            return F.lit(dt.date.fromisoformat(str(v)))
        if self.target == "datetime":
            return F.lit(dt.datetime.fromisoformat(str(v)).isoformat(sep=" ")).cast("timestamp_ntz")
        return F.lit(str(v))

    def apply(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        self.check(df)
        made = self.converted(dtype(df, self.column), fitted)
        if self.invalid_strategy == "replace_default" and self.default_value is not None:
            made = F.coalesce(made, self.default())
        out = replace_columns(df, {self.column: made})
        if self.target in ("categorical", "category"):
            out = out.withMetadata(self.column, {LOGICAL_TYPE: "categorical"})
        return out


def cast_report(df: DataFrame, cast: CastType) -> DataFrame:
    """One row: how many values convert, how many become null."""
    df = normalize_non_finite(df)
    lenient = CastType(cast.column, cast.target_type, "coerce_null", None, cast.format)
    fitted = lenient.fit(df)
    t = dtype(df, cast.column)
    before, made = col(cast.column), lenient.converted(t, fitted)
    after = F.coalesce(made, cast.default()) if cast.invalid_strategy == "replace_default" and cast.default_value is not None else made
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(before.isNull()).alias("nulls_before"),
        F.count_if(made.isNull()).alias("nulls_made"),
        F.count_if(after.isNull()).alias("nulls_after"),
    )
    zero = F.lit(0).cast("bigint")
    invalid = F.greatest(F.col("nulls_made") - F.col("nulls_before"), zero)
    return counts.select(
        F.lit(cast.column).alias("column"),
        F.lit(t.simpleString()).alias("source_type"),
        F.lit(cast.target).alias("target_type"),
        F.lit(cast.invalid_strategy).alias("invalid_strategy"),
        invalid.alias("invalid_count"),
        F.greatest(F.col("n") - F.col("nulls_before") - invalid, zero).alias("valid_count"),
        F.greatest(F.col("nulls_after") - F.col("nulls_before"), zero).alias("new_null_count"),
    )
