"""Scaling, log transform and outlier handling."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tabwright.functions.columns import as_list, col, dtype, is_numeric, replace_columns, require_columns
from tabwright.operators.base import Fitted, Transform
from tabwright.operators.quantiles import exact_quantiles


def _numeric(df: DataFrame, columns: list[str] | str, operation: str) -> list[str]:
    names = as_list(columns)
    if not names:
        raise ValueError(f"{operation}: no columns were given")
    require_columns(df, names)
    wrong = [c for c in names if not is_numeric(dtype(df, c))]
    if wrong:
        raise ValueError(f"{operation}: {wrong[0]!r} holds no numbers")
    return names


def _double(name: str) -> Column:
    return col(name).cast("double")


@dataclass(frozen=True)
class StandardScale(Transform):
    columns: list[str] | str = field(default_factory=list)

    def fit(self, df: DataFrame) -> Fitted:
        names = _numeric(df, self.columns, "standard_scale")
        row = df.agg(*[x for i, c in enumerate(names) for x in (F.avg(_double(c)).alias(f"m{i}"), F.stddev_samp(_double(c)).alias(f"s{i}"))]).first()
        return {"learned_stats": {c: {"mean": row[f"m{i}"], "std": row[f"s{i}"]} for i, c in enumerate(names)}}

    def apply(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        changed = {}
        for c, learned in fitted["learned_stats"].items():
            mean, std = learned["mean"], learned["std"]
            if mean is None:
                continue
            centred = _double(c) - F.lit(mean)
            changed[c] = centred / F.lit(std) if std else centred
        return replace_columns(df, changed)


@dataclass(frozen=True)
class MinMaxScale(Transform):
    columns: list[str] | str = field(default_factory=list)
    min_target: float = 0.0
    max_target: float = 1.0

    def fit(self, df: DataFrame) -> Fitted:
        names = _numeric(df, self.columns, "min_max_scale")
        row = df.agg(*[x for i, c in enumerate(names) for x in (F.min(_double(c)).alias(f"a{i}"), F.max(_double(c)).alias(f"b{i}"))]).first()
        return {"stats": {c: {"min": row[f"a{i}"], "max": row[f"b{i}"]} for i, c in enumerate(names) if row[f"a{i}"] is not None}}

    def apply(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        low, high = float(self.min_target), float(self.max_target)
        changed = {}
        for c, s in fitted["stats"].items():
            if s["max"] > s["min"]:
                changed[c] = (_double(c) - F.lit(s["min"])) / F.lit(s["max"] - s["min"]) * F.lit(high - low) + F.lit(low)
            else:
                changed[c] = F.when(col(c).isNotNull(), F.lit(low))
        return replace_columns(df, changed)


@dataclass(frozen=True)
class LogTransform(Transform):
    columns: list[str] | str = field(default_factory=list)

    def apply(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        names = _numeric(df, self.columns, "log_transform")
        return replace_columns(df, {c: F.when(col(c) >= 0, F.log1p(_double(c))) for c in names})


def iqr_fences(q25: float, q75: float) -> tuple[float, float]:
    iqr = q75 - q25
    return q25 - 1.5 * iqr, q75 + 1.5 * iqr


@dataclass(frozen=True)
class HandleOutliers(Transform):
    columns: list[str] | str = field(default_factory=list)
    method: str = "iqr"
    action: str = "clip"

    def bounds(self, df: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
        """Lower and upper bound per column; columns without values are left out."""
        if self.method == "iqr":
            found = exact_quantiles(df, names, [0.25, 0.75])
            return {c: iqr_fences(*q) for c, q in found.items() if q[0] is not None}
        row = df.agg(*[x for i, c in enumerate(names) for x in (F.avg(_double(c)).alias(f"m{i}"), F.stddev_pop(_double(c)).alias(f"s{i}"))]).first()
        return {
            c: (row[f"m{i}"] - 3.0 * row[f"s{i}"], row[f"m{i}"] + 3.0 * row[f"s{i}"])
            for i, c in enumerate(names) if row[f"m{i}"] is not None
        }

    def fit(self, df: DataFrame) -> Fitted:
        if self.method not in ("iqr", "zscore"):
            raise ValueError(f"method is {self.method!r}; known are iqr and zscore")
        if self.action not in ("clip", "remove"):
            raise ValueError(f"action is {self.action!r}; known are clip and remove")
        names = list(dict.fromkeys(_numeric(df, self.columns, "handle_outliers")))
        if self.action == "clip":
            return {"bounds": self.bounds(df, names)}
        # Removal goes column by column: bounds come from the rows that are left. Each step
        # only adds a filter with two constants to the same scan.
        bounds: dict[str, tuple[float, float]] = {}
        for c in names:
            bounds.update(self.bounds(self.keep(df, bounds), [c]))
        return {"bounds": bounds}

    @staticmethod
    def keep(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
        for c, (low, high) in bounds.items():
            df = df.filter(col(c).isNull() | ((_double(c) >= F.lit(low)) & (_double(c) <= F.lit(high))))
        return df

    def apply(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        if self.action == "remove":
            return self.keep(df, fitted["bounds"])
        changed = {}
        for c, (low, high) in fitted["bounds"].items():
            x = _double(c)
            changed[c] = F.when(x < F.lit(low), F.lit(low)).when(x > F.lit(high), F.lit(high)).otherwise(x)
        return replace_columns(df, changed)

    def report(self, fitted: Fitted) -> dict[str, dict[str, float]]:
        return {c: {"lower_bound": round(low, 2), "upper_bound": round(high, 2)} for c, (low, high) in fitted["bounds"].items()}
