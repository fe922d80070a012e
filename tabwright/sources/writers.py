"""Writing tables as CSV, Parquet or JSON lines, one folder of part files per export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tabwright.functions.columns import as_list, col, require_columns

COMPRESSIONS = ("snappy", "gzip", "zstd")


def export(
    df: DataFrame, path: str, format_type: str = "csv", columns: Sequence[str] | None = None,
    compression: str | None = None, include_header: bool = True,
) -> str:
    """Write a table and return the path. A column subset is pruned in the scan."""
    names = as_list(columns)
    if names:
        require_columns(df, names)
        df = df.select(*[col(c) for c in names])
    kind = format_type.lower().strip()
    if kind == "csv":
        df.write.csv(path, header=include_header, escape='"')
    elif kind == "parquet":
        df.write.parquet(path, compression=compression if compression in COMPRESSIONS else "snappy")
    elif kind == "json":
        df.write.json(path, ignoreNullFields=False)
    else:
        raise ValueError(f"Unsupported export format: '{format_type}'. Supported: csv, parquet, json.")
    return path
