"""Column operations: rename, drop, select, duplicate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tabwright.functions.columns import as_list, col, require_columns
from tabwright.operators.base import Fitted, Transform


@dataclass(frozen=True)
class RenameColumn(Transform):
    mapping: dict[str, str] = field(default_factory=dict)
    old_name: str | None = None
    new_name: str | None = None

    def apply(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        mapping = self.mapping or ({self.old_name: self.new_name} if self.old_name and self.new_name else {})
        if not mapping:
            raise ValueError("rename_column: give a mapping, or an old and a new name")
        require_columns(df, mapping)
        names = [mapping.get(c, c) for c in df.columns]
        if len(set(names)) < len(names):
            raise ValueError(f"after renaming, columns would share a name: {names}")
        return df.withColumnsRenamed(mapping)


@dataclass(frozen=True)
class DropColumn(Transform):
    columns: list[str] | str = field(default_factory=list)

    def apply(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        gone = as_list(self.columns)
        if not gone:
            raise ValueError("no columns were given")
        require_columns(df, gone)
        kept = [c for c in df.columns if c not in gone]
        if not kept:
            raise ValueError("no column would be left")
        return df.select(*[col(c) for c in kept])


@dataclass(frozen=True)
class SelectColumns(Transform):
    columns: list[str] | str = field(default_factory=list)

    def apply(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        wanted = as_list(self.columns)
        if not wanted:
            raise ValueError("no columns were given")
        require_columns(df, wanted)
        return df.select(*[col(c) for c in wanted])


@dataclass(frozen=True)
class DuplicateColumn(Transform):
    source_column: str | None = None
    new_column: str | None = None

    def apply(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        if not self.source_column or not self.new_column:
            raise ValueError("duplicate_column: a source and a new name are to be given")
        require_columns(df, [self.source_column])
        if self.new_column in df.columns:
            raise ValueError(f"the table has a column {self.new_column!r}; the copy needs another name")
        return df.withColumn(self.new_column, col(self.source_column))
