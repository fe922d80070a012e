"""Date parsing and date components."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tabwright.functions.columns import as_list, col, dtype, is_date, is_string, replace_columns, require_columns
from tabwright.functions.dates import DATE_PATTERNS, components, date_source, parse_date, spark_pattern
from tabwright.operators.base import Fitted, Transform
from tabwright.operators.cast import best_pattern


@dataclass(frozen=True)
class ParseDates(Transform):
    columns: list[str] | str = field(default_factory=list)
    format: str | None = None
    extract_components: list[str] | str = field(default_factory=list)

    def fit(self, df: DataFrame) -> Fitted:
        names = as_list(self.columns)
        if not names:
            raise ValueError("parse_dates: no columns were given")
        require_columns(df, names)
        patterns = {}
        for c in names:
            t = dtype(df, c)
            if is_date(t):
                continue
            if self.format:
                patterns[c] = spark_pattern(self.format)
            else:
                patterns[c] = best_pattern(df, col(c), DATE_PATTERNS) if is_string(t) else DATE_PATTERNS[0]
        return {"patterns": patterns}

    def apply(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        made = {c: parse_date(date_source(c, dtype(df, c)), p) for c, p in fitted["patterns"].items()}
        out = replace_columns(df, made)
        extra = {}
        for c in as_list(self.columns):
            extra.update(components(c, as_list(self.extract_components)))
        return out.withColumns(extra) if extra else out
