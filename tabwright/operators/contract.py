"""Checking a table against a declared contract: columns, types, nulls, values."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabwright.functions.columns import as_text, col, dtype, is_float, is_integer, is_numeric, is_string, normalize_non_finite
from tabwright.functions.text import parses_as
from tabwright.operators.facts import tall

SAMPLES = 5
BATCH = 24

ISSUE_SCHEMA = "column string, severity string, issue_type string, expected_type string, actual_type string, affected_rows bigint, sample_values string"


@dataclass(frozen=True)
class ExpectedColumn:
    name: str
    data_type: str = "string"
    required: bool = True
    nullable: bool = True
    allowed_values: tuple | None = None
    min_value: float | None = None
    max_value: float | None = None
    regex_pattern: str | None = None

    @property
    def expected(self) -> str:
        return self.data_type.lower().strip()


def contract_to_json(contract: Iterable[ExpectedColumn]) -> str:
    return json.dumps([asdict(c) for c in contract])


def contract_from_json(text: str) -> list[ExpectedColumn]:
    made = []
    for item in json.loads(text):
        values = item.pop("allowed_values", None)
        made.append(ExpectedColumn(**item, allowed_values=tuple(values) if values is not None else None))
    return made


def contract_type(t: T.DataType) -> str:
    """The contract name of a Spark type."""
    if is_integer(t):
        return "integer"
    if is_numeric(t):
        return "float"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "date" if isinstance(t, T.DateType) else "string"


def contract_from_schema(df: DataFrame) -> DataFrame:
    """The contract a table fulfils by its schema alone."""
    rows = [(f.name, contract_type(f.dataType), True, bool(f.nullable)) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "name string, data_type string, required boolean, nullable boolean")


def is_compatible(t: T.DataType, expected: str) -> bool:
    if expected == "categorical":
        return is_string(t)
    if expected == "float":
        return is_numeric(t)
    return contract_type(t) == expected and (expected != "string" or is_string(t))


@dataclass
class _Check:
    column: ExpectedColumn
    severity: str
    issue_type: str
    violation: Column | None  # counted over the rows; None when the whole table is affected
    always: bool = False  # an issue even without violating rows


def _anchored(pattern: str) -> str:
    return f"^(?:{pattern})"


def _enum_values(c: ExpectedColumn) -> list[str]:
    return sorted({str(v).lower() for v in c.allowed_values or ()})


def _checks(df: DataFrame, contract: list[ExpectedColumn]) -> list[_Check]:
    checks = []
    for e in contract:
        if e.name not in df.columns:
            continue
        t, c = dtype(df, e.name), col(e.name)
        text = as_text(e.name, t)
        if not e.nullable:
            checks.append(_Check(e, "critical", "nullability_violation", c.isNull()))
        if not is_compatible(t, e.expected):
            if e.expected in ("integer", "float"):
                # A fractional number has no integer form, whatever its value.
                readable = F.lit(False) if e.expected == "integer" and is_numeric(t) else parses_as(text, e.expected)
                checks.append(_Check(e, "critical", "type_mismatch", c.isNotNull() & ~readable, always=True))
            elif e.expected == "date":
                checks.append(_Check(e, "warning", "type_mismatch", None, always=True))
            continue
        if is_numeric(t) and (e.min_value is not None or e.max_value is not None):
            outside = F.lit(False)
            if e.min_value is not None:
                outside = outside | (c < F.lit(e.min_value))
            if e.max_value is not None:
                outside = outside | (c > F.lit(e.max_value))
            checks.append(_Check(e, "warning", "constraint_violation", c.isNotNull() & outside))
        if e.regex_pattern and is_string(t):
            checks.append(_Check(e, "warning", "constraint_violation", c.isNotNull() & ~c.rlike(_anchored(e.regex_pattern))))
    return checks


def _counts(df: DataFrame, checks: list[_Check]) -> tuple[int, list[int]]:
    rows, found = None, []
    for start in range(0, max(len(checks), 1), BATCH):
        part = checks[start : start + BATCH]
        row = df.agg(F.count(F.lit(1)).alias("rows"), *[
            (F.count_if(k.violation) if k.violation is not None else F.count(F.lit(1))).alias(f"n{i}") for i, k in enumerate(part)
        ]).first()
        rows = row["rows"]
        found += [row[f"n{i}"] for i in range(len(part))]
    return rows, found


def _samples(df: DataFrame, checks: list[_Check], counts: list[int]) -> dict[int, str]:
    """Up to five distinct violating values per check, the smallest texts first."""
    hit = [i for i, k in enumerate(checks) if counts[i] and k.violation is not None and k.issue_type != "nullability_violation"]
    if not hit:
        return {}
    values = {str(i): F.when(checks[i].violation, as_text(checks[i].column.name, dtype(df, checks[i].column.name))) for i in hit}
    rows = tall(df, list(values), values.__getitem__).filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    kept = rows.withColumn("i", first).filter(F.col("i") <= SAMPLES).select("column", "value").collect()
    return {i: "|".join(sorted(r["value"] for r in kept if r["column"] == str(i))) for i in hit}


def _enums(df: DataFrame, contract: list[ExpectedColumn]) -> list[tuple]:
    """Values beside the allowed ones, for all columns and lists of any length together.

    The distinct values of a column, with their number, are joined to the lists; equal values
    are added up in every task before they move.
    """
    lists = {str(i): _enum_values(e) for i, e in enumerate(contract) if e.name in df.columns and is_compatible(dtype(df, e.name), e.expected)}
    lists = {i: values for i, values in lists.items() if values}
    if not lists:
        return []
    of = lambda i: as_text(contract[int(i)].name, dtype(df, contract[int(i)].name))
    seen = tall(df, list(lists), of).filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    allowed = df.sparkSession.createDataFrame([(i, v) for i, values in lists.items() for v in values], "column string, low string")
    bad = seen.withColumn("low", F.lower("value")).join(allowed, ["column", "low"], "left_anti")
    counts = {r["column"]: r["n"] for r in bad.groupBy("column").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return []
    first = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    kept = bad.withColumn("i", first).filter(F.col("i") <= SAMPLES).select("column", "value").collect()
    sample = {i: "|".join(sorted(r["value"] for r in kept if r["column"] == i)) for i in counts}
    return [(contract[int(i)], "warning", "enum_violation", counts[i], sample[i]) for i in lists if i in counts]


@dataclass
class ContractResult:
    contract: list[ExpectedColumn]
    missing: list[str]
    unexpected: list[str]
    issues: list[tuple]  # rows of ISSUE_SCHEMA
    status: dict[str, str]  # column -> status

    @property
    def compatibility(self) -> str:
        severities = {i[1] for i in self.issues}
        return "incompatible" if "critical" in severities else "warnings" if "warning" in severities else "compatible"


def check_contract(df: DataFrame, contract: Iterable[ExpectedColumn]) -> ContractResult:
    contract = list(contract)
    df = normalize_non_finite(df)
    by_name = {e.name: e for e in contract}
    missing = [e.name for e in contract if e.name not in df.columns]
    unexpected = [c for c in df.columns if c not in by_name]
    checks = _checks(df, contract)
    rows, counts = _counts(df, checks)
    samples = _samples(df, checks, counts)
    issues = [(n, "critical" if by_name[n].required else "warning", "missing_column", by_name[n].data_type, None, rows, "") for n in missing]
    status = {c: "unexpected" for c in unexpected}
    for e in contract:
        if e.name in df.columns:
            status[e.name] = "matched" if is_compatible(dtype(df, e.name), e.expected) else "type_mismatch"
    found = [(k.column, k.severity, k.issue_type, counts[i], samples.get(i, "")) for i, k in enumerate(checks) if counts[i] or k.always]
    for e, severity, kind, n, sample in found + _enums(df, contract):
        issues.append((e.name, severity, kind, e.expected, dtype(df, e.name).simpleString(), n, sample))
        if status[e.name] == "matched":
            status[e.name] = "constraint_violation"
    return ContractResult(contract, missing, unexpected, issues, status)


def contract_issues(df: DataFrame, contract: Iterable[ExpectedColumn], kinds: Iterable[str] | None = None) -> DataFrame:
    wanted = None if kinds is None else set(kinds)
    rows = [i for i in check_contract(df, contract).issues if wanted is None or i[2] in wanted]
    return df.sparkSession.createDataFrame(rows, ISSUE_SCHEMA)


def contract_columns(df: DataFrame, contract: Iterable[ExpectedColumn]) -> DataFrame:
    """One row per table column with its status."""
    result = check_contract(df, contract)
    expected = {e.name: e.expected for e in result.contract}
    rows = [(c, result.status[c], expected.get(c), dtype(df, c).simpleString()) for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "column string, status string, expected_type string, actual_type string")


def contract_report(df: DataFrame, contract: Iterable[ExpectedColumn]) -> DataFrame:
    """The overall verdict, one row."""
    r = check_contract(df, contract)
    row = (
        r.compatibility, len(r.contract), len(r.contract) - len(r.missing), ",".join(r.missing), ",".join(r.unexpected),
        sum(i[1] == "critical" for i in r.issues), sum(i[1] == "warning" for i in r.issues),
    )
    return df.sparkSession.createDataFrame(
        [row],
        "compatibility_status string, total_expected_columns bigint, matched_columns_count bigint, missing_columns string, "
        "unexpected_columns string, critical_issues bigint, warning_issues bigint",
    )
