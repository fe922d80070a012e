"""Deduplication, sorting and paging."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabwright.functions.columns import as_list, as_text, col, normalize_non_finite, order_keys, require_columns, row_hash
from tabwright.operators.base import Fitted, Transform
from tabwright.operators.ranks import rows_from_rank


@dataclass(frozen=True)
class RemoveDuplicates(Transform):
    subset: list[str] | str | None = None
    keep: str = "first"
    order_by: list[str] | str | None = None

    def apply(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        if self.keep not in ("first", "last"):
            raise ValueError(f"keep is {self.keep!r}; known are first and last")
        names = as_list(self.subset)
        require_columns(df, names)
        loose = {f.name: comparable(f.name, f.dataType) for f in df.schema if isinstance(f.dataType, (T.MapType, T.VariantType))}
        if loose:
            return self._with_maps(df, names or df.columns, loose)
        if not names:
            return df.distinct()
        # The least (or greatest) whole row of each group, sort keys first. This combines
        # before the shuffle, so a key held by a third of all rows sends one row per task,
        # where a window over the key would sort the whole group in one task.
        keys = [c for c in order_keys(df, self.order_by) if c not in names]
        if not keys:
            return df.select(*[col(c) for c in names]).distinct().select(*[col(c) for c in df.columns])
        whole = F.struct(*[col(c).alias(f"k{i}") for i, c in enumerate(keys)])
        pick = F.min(whole) if self.keep == "first" else F.max(whole)
        rows = df.groupBy(*[col(c) for c in names]).agg(pick.alias("__row"))
        source = {c: F.col(f"__row.k{i}") for i, c in enumerate(keys)}
        return rows.select(*[source.get(c, col(c)).alias(c) for c in df.columns])


    def _with_maps(self, df: DataFrame, names: list[str], loose: dict[str, Column]) -> DataFrame:
        """Maps and variants have no order of their own: rows are compared by a form that has."""
        shown = {c: loose.get(c, col(c)) for c in df.columns}
        order = F.struct(*[shown[c] for c in as_list(self.order_by) + [c for c in df.columns if c not in as_list(self.order_by)]])
        pick = (F.min_by if self.keep == "first" else F.max_by)(F.struct(*[col(c).alias(f"k{i}") for i, c in enumerate(df.columns)]), order)
        rows = df.groupBy(*[shown[c].alias(f"g{i}") for i, c in enumerate(names)]).agg(pick.alias("__row"))
        return rows.select(*[F.col(f"__row.k{i}").alias(c) for i, c in enumerate(df.columns)])


def comparable(name: str, t: T.DataType) -> Column:
    """The column in a form that can be grouped: map entries in the order of their keys, variants as JSON."""
    if isinstance(t, T.MapType):
        return F.array_sort(F.map_entries(col(name)))
    return as_text(name, t) if isinstance(t, T.VariantType) else col(name)


def duplicate_groups(df: DataFrame) -> DataFrame:
    """``n`` for every distinct row: how often it occurs.

    Two 64-bit hashes of each row are counted first, so 16 bytes a row are shuffled; only rows
    whose hashes repeat are then compared whole.
    """
    df = normalize_non_finite(df)
    whole = [comparable(f.name, f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema)]
    if not whole:
        return df.groupBy().agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    rows = df.select(*whole)
    hashed = rows.withColumns({"h1": F.xxhash64(*rows.columns), "h2": F.xxhash64(F.lit(1), *rows.columns)})
    counted = hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    again = hashed.join(counted.filter("n > 1").select("h1", "h2"), ["h1", "h2"], "left_semi")
    return counted.filter("n = 1").select("n").unionByName(again.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")).select("n"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Row count and surplus copies."""
    return duplicate_groups(df).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("n") - F.lit(1)), F.lit(0)).alias("duplicate_count"),
    )


def _sort(c: Column, descending: bool) -> Column:
    return c.desc_nulls_first() if descending else c.asc_nulls_first()


@dataclass(frozen=True)
class SortRows(Transform):
    columns: list[str] | str = field(default_factory=list)
    descending: bool = False

    def apply(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        names = as_list(self.columns)
        if not names:
            raise ValueError("sort_rows: no columns were given")
        require_columns(df, names)
        # Equal keys may come in any order. Two further keys let range partitioning cut
        # through a hot key: the row hash, and for copies of one row the input partition.
        spread = df.withColumns({"__hash": row_hash(df), "__from": F.spark_partition_id()})
        ordered = spread.orderBy(*[_sort(col(c), self.descending) for c in names], "__hash", "__from")
        return ordered.select(*[col(c) for c in df.columns])


def head_sample(df: DataFrame, order_by: str | Sequence[str] | None = None, n: int = 5) -> DataFrame:
    df = normalize_non_finite(df)
    return df.orderBy(*[_sort(col(c), False) for c in order_keys(df, order_by)]).limit(n)


def page_rows(df: DataFrame, page: int, page_size: int, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """One page of the table in the order of ``order_by``."""
    if page < 1 or not 1 <= page_size <= 500:
        raise ValueError(f"page {page} of {page_size} rows: pages count from 1 and hold 1 to 500 rows")
    df = normalize_non_finite(df)
    return rows_from_rank(df, order_keys(df, order_by), (page - 1) * page_size, page_size)


def page_info(df: DataFrame, page: int, page_size: int) -> DataFrame:
    """What goes with a page, one row: sizes of the table and the types of its columns."""
    rows = df.agg(F.count(F.lit(1)).alias("total_rows"))
    types = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    return rows.select(
        F.lit(page).cast("bigint").alias("page"), F.lit(page_size).cast("bigint").alias("page_size"), "total_rows",
        F.ceil(F.col("total_rows") / F.lit(page_size)).alias("total_pages"), F.lit(len(df.columns)).cast("bigint").alias("total_columns"), F.lit(types).alias("types"),
    )
