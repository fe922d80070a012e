"""One-hot and ordinal encoding."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tabwright.functions.columns import as_list, as_text, col, dtype, order_keys, replace_columns, require_columns
from tabwright.operators.base import Fitted, Transform


def indicator_name(column: str, value: str, taken: set[str]) -> str:
    base = f"{column}_{re.sub(r'\W+', '_', value).strip('_') or 'value'}"
    name, i = base, 0
    while name in taken:
        i += 1
        name = f"{base}_{i}"
    return name


# Indicators that one column may get where no bound is given: a wider table is hardly meant.
MAX_CATEGORIES = 1000


@dataclass(frozen=True)
class OneHotEncode(Transform):
    """One 0/1 column per category; a missing value is 0 in all of them.

    ``max_categories`` bounds the categories: those seen first in row order, or with ``pick``
    "frequent" those held by most rows (of equally frequent ones the least). With ``other`` the
    column ``{column}_other`` marks values beyond the bound, and the fitted result says how many
    different values these are. Without a bound, more than MAX_CATEGORIES categories are an error.
    """

    columns: list[str] | str = field(default_factory=list)
    drop_first: bool = False
    max_categories: int | None = None
    order_by: list[str] | str | None = None
    pick: str = "first"
    other: bool = False

    def categories(self, df: DataFrame, column: str) -> list[str]:
        """The chosen categories; no more than the bound and one leave the executors."""
        text = as_text(column, dtype(df, column))
        groups = df.filter(col(column).isNotNull()).groupBy(text.alias("value"))
        if self.pick == "frequent":
            ordered = groups.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")
        else:
            keys = [c for c in order_keys(df, self.order_by) if c != column] if self.order_by is None else as_list(self.order_by)
            first = F.min(F.struct(*[col(c) for c in keys])) if keys else F.min(text)
            ordered = groups.agg(first.alias("first_seen")).orderBy("first_seen", "value")
        if self.max_categories is not None:
            return [r["value"] for r in ordered.limit(int(self.max_categories)).collect()]
        found = [r["value"] for r in ordered.limit(MAX_CATEGORIES + 1).collect()]
        if len(found) > MAX_CATEGORIES:
            raise ValueError(f"{column!r} has more than {MAX_CATEGORIES} categories; give max_categories to encode some of them")
        return found

    def fit(self, df: DataFrame) -> Fitted:
        names = as_list(self.columns)
        if not names:
            raise ValueError("one_hot_encode: no columns were given")
        if self.pick not in ("first", "frequent"):
            raise ValueError(f"pick is {self.pick!r}; it may be 'first' or 'frequent'")
        require_columns(df, names)
        taken, mapping, others = set(df.columns), [], []
        for c in names:
            values = self.categories(df, c)
            for v in values[1:] if self.drop_first and len(values) > 1 else values:
                name = indicator_name(c, v, taken)
                taken.add(name)
                mapping.append([c, v, name])
            if self.other:
                name = indicator_name(c, "other", taken)
                taken.add(name)
                text = as_text(c, dtype(df, c))
                left = df.filter(col(c).isNotNull() & ~text.isin(values)).agg(F.count_distinct(text)).first()[0]
                others.append([c, values, name, left])
            taken.discard(c)
        return {"category_mapping": mapping} | ({"other_mapping": others} if self.other else {})

    def apply(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        gone = as_list(self.columns)
        flags = [
            F.coalesce(as_text(c, dtype(df, c)) == F.lit(v), F.lit(False)).cast("tinyint").alias(name)
            for c, v, name in fitted["category_mapping"]
        ]
        flags += [
            F.coalesce(~as_text(c, dtype(df, c)).isin(values), F.lit(False)).cast("tinyint").alias(name) for c, values, name, _ in fitted.get("other_mapping", [])
        ]
        return df.select(*[col(c) for c in df.columns if c not in gone], *flags)


@dataclass(frozen=True)
class OrdinalEncode(Transform):
    column: str | None = None
    order: list = field(default_factory=list)

    def apply(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        if not self.column or not self.order:
            raise ValueError("ordinal_encode: a column and its categories in order are to be given")
        require_columns(df, [self.column])
        ranks = {}
        for i, v in enumerate(self.order):
            ranks.setdefault(str(v), i)
        table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
        return replace_columns(df, {self.column: F.try_element_at(table, as_text(self.column, dtype(df, self.column)))})
