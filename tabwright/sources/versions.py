"""Immutable table versions with a queryable lineage log.

A version is a Parquet folder that is never written again. Three append-only Parquet logs
sit beside the data: versions, the current-version pointer and transformation runs. Data is
written before its log row, so a lost job leaves at most an unreferenced folder. One writer
per table at a time is assumed.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabwright.functions.columns import as_text
from tabwright.operators.dispatch import fit_transform, transform_summary
from tabwright.operators.profile import null_counts

LOG_BLOCK = 1000  # entries of the version log that are looked at together

VERSIONS = (
    "version_number bigint, branch_name string, parent_version bigint, path string, row_count bigint, column_count bigint, "
    "schema_json string, operation string, params_json string, created_at timestamp"
)
POINTERS = "sequence bigint, version_number bigint, created_at timestamp"
RUNS = (
    "run_id string, source_version bigint, target_version bigint, operation string, params_json string, status string, "
    "summary_json string, error_message string, created_at timestamp"
)


def now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and two order-independent sums over digests of the rows, one row.

    A row's digest is the MD5 of its cells as text, each with its length in bytes, so neither
    neighbouring cells nor missing ones can be mistaken for each other.
    """
    cells = []
    for f in df.schema:
        text = as_text(f.name, f.dataType)
        cells.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    digest = F.md5(F.concat(*cells))
    low, high = (F.conv(F.substring(F.col("d"), at, 15), 16, 10).cast("bigint") for at in (1, 17))
    rows = df.select(digest.alias("d"))
    return rows.agg(
        F.count(F.lit(1)).alias("row_count"), F.coalesce(F.bit_xor(low), F.lit(0).cast("bigint")).alias("hash_xor"),
        F.coalesce(F.sum(high.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"),
    )


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(kind, column, old_value, new_value, diff)``: size, columns, types and changed null counts."""
    spark: SparkSession = old.sparkSession
    old_types, new_types = dict(old.dtypes), dict(new.dtypes)
    rows: list[tuple] = [("column_count", None, str(len(old_types)), str(len(new_types)), len(new_types) - len(old_types))]
    rows += [("column_added", c, None, new_types[c], None) for c in sorted(set(new_types) - set(old_types))]
    rows += [("column_removed", c, old_types[c], None, None) for c in sorted(set(old_types) - set(new_types))]
    common = sorted(set(old_types) & set(new_types))
    rows += [("type_changed", c, old_types[c], new_types[c], None) for c in common if old_types[c] != new_types[c]]
    schema = "kind string, column string, old_value string, new_value string, diff bigint"
    known = spark.createDataFrame(rows, schema)
    sizes = transform_summary(old, new).select(
        F.lit("row_count").alias("kind"), F.lit(None).cast("string").alias("column"), F.col("rows_before").alias("o"), F.col("rows_after").alias("n")
    )
    # One row per column on both sides.
    before, after = (null_counts(d).select("column", F.col("missing_count").alias(n)) for d, n in ((old, "o"), (new, "n")))
    holes = before.join(after, "column").filter(F.col("o") != F.col("n")).select(F.lit("null_count").alias("kind"), "column", "o", "n")
    measured = sizes.unionByName(holes).select(
        "kind", "column", F.col("o").cast("string").alias("old_value"), F.col("n").cast("string").alias("new_value"), (F.col("n") - F.col("o")).alias("diff")
    )
    return known.unionByName(measured)


class VersionedTable:
    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")

    # --- logs ---------------------------------------------------------------------
    def _append(self, log: str, schema: str, row: tuple) -> None:
        fields = T.StructType.fromDDL(schema)
        line = [F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)]
        self.spark.range(0, 1, 1, 1).select(*line).write.mode("append").parquet(f"{self.base}/log/{log}")

    def _log(self, log: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.base}/log/{log}")
        except AnalysisException:  # nothing logged yet
            return self.spark.createDataFrame([], schema)

    def versions(self) -> DataFrame:
        """Newest first."""
        return self._log("versions", VERSIONS).orderBy(F.desc("version_number"))

    def runs(self) -> DataFrame:
        return self._log("runs", RUNS).orderBy(F.desc("created_at"))

    def _latest(self) -> int:
        return self._log("versions", VERSIONS).agg(F.max("version_number")).first()[0] or 0

    def current(self) -> int:
        """The pointer if there is one, else the highest version."""
        pointed = self._log("pointers", POINTERS).agg(F.max_by("version_number", "sequence")).first()[0]
        return pointed or self._latest()

    def _row(self, version: int | None) -> Any:
        wanted = self.current() if version is None else version
        row = self._log("versions", VERSIONS).filter(F.col("version_number") == wanted).first()
        if row is None:
            raise ValueError(f"No version {wanted} at {self.base}")
        return row

    def _point(self, version: int) -> None:
        self._append("pointers", POINTERS, (time.time_ns(), version, now()))

    # --- writing ------------------------------------------------------------------
    def _store(self, df: DataFrame, branch: str, parent: int | None, operation: str, params: dict) -> int:
        number = self._latest() + 1
        path = f"{self.base}/data/v{number}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        stored = self.spark.read.parquet(path)
        self._append("versions", VERSIONS, (
            number, branch, parent, path, stored.count(), len(stored.columns), stored.schema.json(), operation, json.dumps(params), now(),
        ))
        self._point(number)
        return number

    def create(self, df: DataFrame) -> int:
        if self._latest():
            raise ValueError(f"{self.base} already has versions")
        return self._store(df, "main", None, "upload", {})

    def apply(self, operation: str, params: dict | None = None, version: int | None = None, branch: str | None = None) -> int:
        """Run an operation on a version and store the result as the next one."""
        params = params or {}
        source = self._row(version)
        run = uuid.uuid4().hex
        before = self.spark.read.parquet(source["path"])
        try:
            after, _ = fit_transform(before, operation, params)
            number = self._store(after, branch or source["branch_name"], source["version_number"], operation, params)
        except Exception as err:
            self._append("runs", RUNS, (run, source["version_number"], None, operation, json.dumps(params), "failed", None, str(err), now()))
            raise
        made = self._row(number)
        summary = {
            "rows_before": source["row_count"], "rows_after": made["row_count"], "rows_affected": abs(source["row_count"] - made["row_count"]),
            "columns_before": source["column_count"], "columns_after": made["column_count"],
            "columns_affected": abs(source["column_count"] - made["column_count"]),
        }
        self._append("runs", RUNS, (run, source["version_number"], number, operation, json.dumps(params), "completed", json.dumps(summary), None, now()))
        return number

    def restore(self, version: int) -> int:
        """Make a version current again; nothing is deleted."""
        self._point(self._row(version)["version_number"])
        return version

    def branch(self, version: int, name: str) -> int:
        """A new version on another branch that shares the data folder."""
        source = self._row(version).asDict()
        number = self._latest() + 1
        self._append("versions", VERSIONS, (
            number, name, version, source["path"], source["row_count"], source["column_count"], source["schema_json"],
            "branch", json.dumps({"from_version": version}), now(),
        ))
        self._point(number)
        return number

    # --- reading ------------------------------------------------------------------
    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self._row(version)["path"])

    def compare(self, old: int, new: int) -> DataFrame:
        return compare(self.read(old), self.read(new))

    def fingerprint(self, version: int | None = None) -> DataFrame:
        return fingerprint(self.read(version))

    def lineage(self, version: int | None = None) -> list[tuple[str, dict]]:
        """The operations from the first version to the given one. The log is read in blocks of
        version numbers, backwards, and only as far as the ancestors go."""
        number = self.current() if version is None else version
        log, steps = self._log("versions", VERSIONS), []
        while number is not None:
            block = log.filter(F.col("version_number").between(number - LOG_BLOCK + 1, number)).collect()
            rows = {r["version_number"]: r for r in block}
            if number not in rows:
                break
            while (at := rows.get(number)) is not None:
                if at["operation"] not in ("upload", "branch"):
                    steps.append((at["operation"], json.loads(at["params_json"])))
                number = at["parent_version"]
        return steps[::-1]

    def replay(self, df: DataFrame, version: int | None = None) -> DataFrame:
        """The recorded operations of a version, run again on another table."""
        for operation, params in self.lineage(version):
            df, _ = fit_transform(df, operation, params)
        return df
