"""Text clean-up transforms."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tabwright.functions.columns import as_list, col, replace_columns, require_columns, string_columns
from tabwright.functions.text import collapse_space, trim_all
from tabwright.operators.base import Fitted, Transform

CASES = {"lower": F.lower, "upper": F.upper, "title": F.initcap}


@dataclass(frozen=True)
class TrimWhitespace(Transform):
    columns: list[str] | str = field(default_factory=list)

    def apply(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        names = as_list(self.columns) or string_columns(df)
        require_columns(df, names)
        return replace_columns(df, {c: trim_all(col(c)) for c in names})


@dataclass(frozen=True)
class NormalizeStrings(Transform):
    columns: list[str] | str = field(default_factory=list)

    def apply(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        names = as_list(self.columns) or string_columns(df)
        require_columns(df, names)
        return replace_columns(df, {c: collapse_space(col(c)) for c in names})


@dataclass(frozen=True)
class ChangeCase(Transform):
    columns: list[str] | str = field(default_factory=list)
    case: str = "lower"

    def apply(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        change = CASES.get(self.case.lower())
        if change is None:
            raise ValueError(f"case is {self.case!r}; known are lower, upper and title")
        names = as_list(self.columns)
        if not names:
            raise ValueError("no columns were given")
        require_columns(df, names)
        return replace_columns(df, {c: change(col(c)) for c in names})


@dataclass(frozen=True)
class ReplaceText(Transform):
    columns: list[str] | str = field(default_factory=list)
    pattern: str = ""
    replacement: str = ""
    is_regex: bool = False

    def replaced(self, c: Column) -> Column:
        if self.is_regex:
            return F.regexp_replace(c, self.pattern, self.replacement)
        if not self.pattern:
            # The empty text matches between all characters.
            return F.regexp_replace(c, "", F.lit(self.replacement.replace("\\", "\\\\").replace("$", "\\$")))
        return F.replace(c, F.lit(self.pattern), F.lit(self.replacement))

    def apply(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        names = as_list(self.columns)
        if not names:
            raise ValueError("no columns were given")
        require_columns(df, names)
        return replace_columns(df, {c: self.replaced(col(c)) for c in names})
