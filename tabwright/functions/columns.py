"""Column roles, name checks and small column expressions shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

INFINITY = float("inf")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col(quoted(name))


def as_list(names: str | Iterable[str] | None) -> list[str]:
    if names is None:
        return []
    return [names] if isinstance(names, str) else list(names)


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Fail when a name is not a column. Unlike Spark's resolver this is case-sensitive."""
    present = set(df.columns)
    missing = [n for n in names if n not in present]
    if missing:
        raise ValueError(f"the table has no columns {missing}")


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def is_float(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType))


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_date(t: T.DataType) -> bool:
    return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_string(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


def is_nested(t: T.DataType) -> bool:
    return isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def date_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_date(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_string(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Everything that is neither a number nor a date."""
    return [f.name for f in df.schema if not is_numeric(f.dataType) and not is_date(f.dataType)]


def role(t: T.DataType) -> str:
    if is_numeric(t):
        return "numeric"
    return "date" if is_date(t) else "categorical"


def as_text(name: str, t: T.DataType) -> Column:
    """The value as text; nested values as JSON."""
    if isinstance(t, T.BinaryType):
        return F.base64(col(name))
    if isinstance(t, T.VariantType):
        return F.to_json(col(name))
    return F.to_json(col(name)) if is_nested(t) else col(name).cast("string")


def finite(name: str, t: T.DataType) -> Column:
    """The column with NaN and infinities read as missing."""
    c = col(name)
    if not is_float(t):
        return c
    return F.when(F.isnan(c) | c.isin(INFINITY, -INFINITY), F.lit(None)).otherwise(c)


def normalize_non_finite(df: DataFrame) -> DataFrame:
    """NaN and infinities to null in every float column, in one projection."""
    if not any(is_float(f.dataType) for f in df.schema):
        return df
    return df.select(*[finite(f.name, f.dataType).alias(f.name) for f in df.schema])


def replace_columns(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
    """One projection that swaps the given columns and keeps the column order."""
    return df.select(*[changed[c].alias(c) if c in changed else col(c) for c in df.columns])


def order_keys(df: DataFrame, order_by: str | Sequence[str] | None) -> list[str]:
    """The requested sort keys followed by all other sortable columns.

    The appended columns make the order total up to identical rows, so results that
    depend on row order do not depend on the partitioning.
    """
    keys = as_list(order_by)
    require_columns(df, keys)
    rest = [f.name for f in df.schema if f.name not in keys and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return keys + rest


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a whole row; used to spread rows, never to decide equality."""
    return F.xxhash64(*[as_text(f.name, f.dataType) if isinstance(f.dataType, (T.MapType, T.VariantType)) else col(f.name) for f in df.schema])
