"""Machine-learning readiness: findings, recommendations and a score."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tabwright.functions.columns import col, dtype, is_numeric, is_string, normalize_non_finite
from tabwright.operators import facts as fx
from tabwright.operators.facts import percentage
from tabwright.operators.split import SPLIT_COLUMN

# --- fixed values: points and limits ---------------------------------------------------
NO_TARGET, UNKNOWN_TARGET, TARGET_NULLS = 30.0, 40.0, 25.0
FEW_CLASSES, MANY_CLASSES, MANY_CLASSES_LIMIT = 30.0, 20.0, 100
NON_NUMERIC_TARGET = 30.0
NULL_WEIGHT, NULL_CAP, NULL_CRITICAL = 0.15, 8.0, 30
CONSTANT_POINTS = 5.0
ID_POINTS, ID_SHARE, ID_MIN_ROWS = 8.0, 0.85, 10
ENCODING_LIMIT = 20
RAW_TEXT_POINTS, NO_SPLIT_POINTS = 10.0, 5.0
READY, ATTENTION = 80.0, 50.0
TASKS = ("classification", "regression", "clustering")
# ---------------------------------------------------------------------------------------

FINDING_SCHEMA = "category string, severity string, code string, column string, rows_affected bigint, points double, recommended_operation string"


@dataclass
class Audit:
    findings: list[tuple] = field(default_factory=list)
    steps: list[tuple[str, dict]] = field(default_factory=list)
    unresolved: list[str] = field(default_factory=list)

    def find(self, category: str, severity: str, code: str, column: str | None, rows: int, points: float, operation: str) -> None:
        self.findings.append((category, severity, code, column, rows, points, operation))

    def recommend(self, operation: str, **params) -> None:
        self.steps.append((operation, params))

    @property
    def score(self) -> float:
        return max(0.0, min(100.0, round(100.0 - sum(f[5] for f in self.findings), 1)))

    @property
    def status(self) -> str:
        if self.score >= READY and not self.unresolved:
            return "ready"
        return "needs_attention" if self.score >= ATTENTION else "not_ready"


def class_count(df: DataFrame, column: str) -> int:
    """Distinct non-null values of the target."""
    present = normalize_non_finite(df).filter(col(column).isNotNull())
    return present.groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).count()


def _target(df: DataFrame, audit: Audit, table: fx.TableFacts, task: str, target: str | None) -> None:
    if not target:
        audit.find("target_quality", "critical", "NO_TARGET", None, table.rows, NO_TARGET, "specify_target")
        audit.unresolved.append("NO_TARGET")
        return
    if target not in df.columns:
        audit.find("target_quality", "critical", "UNKNOWN_TARGET", target, table.rows, UNKNOWN_TARGET, "select_target")
        audit.unresolved.append("UNKNOWN_TARGET")
        return
    missing = table.missing(target)
    if missing:
        audit.find("target_quality", "critical", "TARGET_NULLS", target, missing, TARGET_NULLS, "drop_missing")
        audit.recommend("drop_missing", columns=[target], how="any")
        audit.unresolved.append("TARGET_NULLS")
    if task == "classification":
        classes = class_count(df, target)
        if classes < 2:
            audit.find("target_quality", "critical", "FEW_CLASSES", target, table.rows, FEW_CLASSES, "verify_target")
        elif classes > MANY_CLASSES_LIMIT:
            audit.find("target_quality", "warning", "MANY_CLASSES", target, table.rows, MANY_CLASSES, "reframe_task")
    elif not is_numeric(dtype(df, target)):
        audit.find("target_quality", "critical", "NON_NUMERIC_TARGET", target, table.rows, NON_NUMERIC_TARGET, "cast_type")
        audit.recommend("cast_type", column=target, target_type="float")


def _feature(audit: Audit, table: fx.TableFacts, f: fx.ColumnFacts, distinct: int | None) -> None:
    missing = table.missing(f.name)
    if missing:
        share = percentage(missing, table.rows, 1)
        fill = "fill_missing_median" if is_numeric(f.type) else "fill_missing_constant"
        audit.find("missing_data", "warning" if share < NULL_CRITICAL else "critical", "FEATURE_NULLS", f.name, missing, min(share * NULL_WEIGHT, NULL_CAP), fill)
        audit.recommend(fill, columns=[f.name], **({} if is_numeric(f.type) else {"value": "Unknown"}))
    if f.single:
        audit.find("feature_types", "warning", "CONSTANT_FEATURE", f.name, table.rows, CONSTANT_POINTS, "drop_column")
        audit.recommend("drop_column", columns=[f.name])
    if distinct is None:
        return
    if table.rows > ID_MIN_ROWS and distinct / table.rows > ID_SHARE:
        audit.find("leakage", "warning", "ID_COLUMN", f.name, table.rows, ID_POINTS, "drop_column")
        audit.recommend("drop_column", columns=[f.name])
    elif distinct <= ENCODING_LIMIT:
        audit.recommend("one_hot_encode", columns=[f.name], drop_first=True)


def audit(df: DataFrame, task_type: str = "classification", target_column: str | None = None) -> Audit:
    if task_type not in TASKS:
        raise ValueError(f"task_type must be one of: {', '.join(TASKS)}.")
    result = Audit()
    table = fx.measure(df, detail=False)
    if task_type != "clustering":
        _target(df, result, table, task_type, target_column)
    # The split label is bookkeeping, not a feature.
    features = [c for c in df.columns if c not in (target_column, SPLIT_COLUMN)]
    texts = [c for c in features if is_string(dtype(df, c))]
    distinct = fx.distinct_counts(df, texts)
    for c in features:
        _feature(result, table, table.columns[c], distinct.get(c))
    if texts:
        result.find("feature_types", "warning", "RAW_TEXT_FEATURES", None, table.rows, RAW_TEXT_POINTS, "one_hot_encode")
    if SPLIT_COLUMN not in df.columns:
        result.find("leakage", "info", "NO_SPLIT", None, table.rows, NO_SPLIT_POINTS, "train_test_split")
        result.recommend("train_test_split", test_size=0.2, random_state=42)
    return result


def ml_findings(df: DataFrame, task_type: str = "classification", target_column: str | None = None, codes: list[str] | None = None) -> DataFrame:
    rows = [f for f in audit(df, task_type, target_column).findings if codes is None or f[2] in codes]
    return df.sparkSession.createDataFrame(rows, FINDING_SCHEMA)


def ml_target_classes(df: DataFrame, target_column: str) -> DataFrame:
    """How many classes the target has and whether that suits a classification."""
    classes = class_count(df, target_column)
    verdict = "too_few" if classes < 2 else "too_many" if classes > MANY_CLASSES_LIMIT else "ok"
    return df.sparkSession.createDataFrame([(target_column, classes, verdict)], "column string, classes bigint, verdict string")


def ml_id_columns(df: DataFrame) -> DataFrame:
    """Text columns with their distinct share and whether they look like identifiers."""
    names = [c for c in df.columns if is_string(dtype(df, c))]
    rows, distinct = df.count(), fx.distinct_counts(df, names)
    made = [(c, distinct[c], distinct[c] / rows if rows else 0.0, rows > ID_MIN_ROWS and distinct[c] / rows > ID_SHARE) for c in names]
    return df.sparkSession.createDataFrame(made, "column string, unique_count bigint, unique_share double, is_identifier boolean")


def ml_encoding_candidates(df: DataFrame) -> DataFrame:
    """Text columns with few enough values for one-hot encoding."""
    found = [r for r in ml_id_columns(df).collect() if not r["is_identifier"] and r["unique_count"] <= ENCODING_LIMIT]
    return df.sparkSession.createDataFrame([(r["column"], r["unique_count"]) for r in found], "column string, unique_count bigint")


def ml_readiness(df: DataFrame, task_type: str = "classification", target_column: str | None = None) -> DataFrame:
    a = audit(df, task_type, target_column)
    row = (task_type, target_column, a.score, a.status, len(a.findings), len(a.steps), len(a.unresolved))
    return df.sparkSession.createDataFrame(
        [row],
        "task_type string, target_column string, readiness_score double, overall_status string, findings bigint, recommendations bigint, unresolved bigint",
    )


def ml_recommendations(df: DataFrame, task_type: str = "classification", target_column: str | None = None) -> DataFrame:
    """Numbered steps, each one runnable with ``run_transform(df, operation, json.loads(params_json))``."""
    steps = audit(df, task_type, target_column).steps
    rows = [(i, operation, json.dumps(params)) for i, (operation, params) in enumerate(steps, 1)]
    return df.sparkSession.createDataFrame(rows, "step bigint, operation string, params_json string")
