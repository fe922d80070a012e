"""Measurements of a table that profiles, validation and readiness checks are decided on.

Each function runs one or two jobs and returns a few numbers per column, so the rules that
follow work on a bounded amount of data on the driver while every row stays on Spark.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tabwright.functions.columns import (
    INFINITY, as_text, categorical_columns, col, dtype, finite, is_date, is_float, is_nested, is_numeric, normalize_non_finite, order_keys,
)
from tabwright.functions.text import DIRTY_WORDS, looks_like_date, looks_like_float
from tabwright.operators.dedup import duplicate_count
from tabwright.operators.quantiles import Watch, exact_quantiles, searched_type, started, starts
from tabwright.operators.scale import iqr_fences

# Columns measured in one aggregation. The scan of a batch reads only its columns.
BATCH = 24
DIGEST = 64  # characters of a SHA-256 in hexadecimal


@dataclass
class ColumnFacts:
    name: str
    type: T.DataType
    present: int = 0
    single: bool = True  # at most one distinct value, missing ones aside
    mean: float | None = None
    std: float | None = None
    low: float | None = None
    high: float | None = None
    first_text: str | None = None
    last_text: str | None = None
    numeric_looks: int = 0
    date_looks: int = 0
    non_finite: int = 0
    dirt: list[str] = field(default_factory=list)  # words that stand for "missing"
    only: str | None = None  # the value of a text column that has just one


@dataclass
class TableFacts:
    rows: int
    columns: dict[str, ColumnFacts]
    starts: dict[str, tuple] = field(default_factory=dict)  # of exact quantile searches

    def missing(self, name: str) -> int:
        return self.rows - self.columns[name].present


def percentage(part: int, whole: int, digits: int | None = None) -> float:
    share = part / whole * 100 if whole else 0.0
    return share if digits is None else round(share, digits)


def _measures(name: str, t: T.DataType, i: int, detail: bool, sketch: bool) -> list[Column]:
    c = col(name)
    out = [F.count(c).alias(f"n{i}")]
    if sketch and is_numeric(t):
        # Least and greatest value come with the sketch.
        return out + ([F.avg(c.cast("double")).alias(f"mean{i}"), F.stddev_pop(c.cast("double")).alias(f"std{i}")] if detail else [])
    if is_numeric(t) or is_date(t) or isinstance(t, T.BooleanType):
        out.append((F.min(c) == F.max(c)).alias(f"one{i}"))
    else:
        # Text in the buffer would keep the aggregate from running as generated code, so
        # hashes are compared first; equal ones are checked on the texts.
        h = F.when(c.isNotNull(), F.xxhash64(as_text(name, t)))
        out.append((F.min(h) == F.max(h)).alias(f"hash{i}"))
    if not detail:
        return out
    if is_numeric(t):
        x = c.cast("double")
        out += [F.avg(x).alias(f"mean{i}"), F.stddev_pop(x).alias(f"std{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
    elif is_date(t):
        out += [F.min(c).cast("string").alias(f"first{i}"), F.max(c).cast("string").alias(f"last{i}")]
    elif not isinstance(t, T.BooleanType):
        text = as_text(name, t)
        out += [F.count_if(looks_like_float(text)).alias(f"num{i}"), F.count_if(looks_like_date(text)).alias(f"date{i}")]
    return out


def measure(df: DataFrame, detail: bool = True, sketch: bool = False) -> TableFacts:
    """Counts of all columns and whether they vary; with ``detail`` also moments, bounds and
    text looks; with ``sketch`` what a search for quantiles of the numbers begins with.

    Numbers with sketches and the other columns are two aggregations, as a sketch keeps what stands
    beside it from running as generated code; each column is read by one of them. Text columns
    that may hold a single value are read once more."""
    fields = list(df.schema)
    odd = {f.name: f"__odd{i}" for i, f in enumerate(fields) if is_float(f.dataType)}
    flags = [(F.isnan(col(c)) | col(c).isin(INFINITY, -INFINITY)).alias(flag) for c, flag in odd.items()]
    df = df.select(*[finite(f.name, f.dataType).alias(f.name) for f in fields], *flags)
    rows, facts, unsure, begun = None, {}, [], {}
    groups = [[f for f in fields if is_numeric(f.dataType) == number] for number in (True, False)] if sketch else [fields]
    parts = [g[i : i + BATCH] for g in groups for i in range(0, len(g), BATCH)]
    for part in parts or [[]]:
        strange = [F.count_if(F.col(odd[f.name])).alias(f"odd{i}") for i, f in enumerate(part) if f.name in odd]
        numbers = {f"q{i}": f.name for i, f in enumerate(part) if sketch and is_numeric(f.dataType)}
        kinds = {k: searched_type(dtype(df, c)) for k, c in numbers.items()}
        sketched = [m for k, c in numbers.items() for m in starts(k, col(c).cast(kinds[k]), kinds[k])]
        row = df.agg(F.count(F.lit(1)).alias("rows"), *[m for i, f in enumerate(part) for m in _measures(f.name, f.dataType, i, detail, sketch)], *strange, *sketched).first()
        rows = row["rows"] if rows is None else rows
        r = row.asDict()
        begun.update({c: started(r, k, kinds[k]) for k, c in numbers.items()})
        for i, f in enumerate(part):
            if f.name in begun:
                n, _, low, high = begun[f.name]
                r |= {f"one{i}": None if not n else low == high, f"min{i}": None if not n else float(low), f"max{i}": None if not n else float(high)}
            if r.get(f"hash{i}"):
                unsure.append(f.name)
            facts[f.name] = ColumnFacts(
                f.name, f.dataType, r[f"n{i}"], r.get(f"one{i}", r.get(f"hash{i}")) is not False,
                r.get(f"mean{i}"), r.get(f"std{i}"), r.get(f"min{i}"), r.get(f"max{i}"),
                r.get(f"first{i}"), r.get(f"last{i}"), r.get(f"num{i}", 0), r.get(f"date{i}", 0), r.get(f"odd{i}", 0),
            )
    if unsure:
        texts = {c: as_text(c, dtype(df, c)) for c in unsure}
        same = df.agg(*[x for x in texts.values() for x in (F.min(x), F.max(x))]).first()
        for i, c in enumerate(unsure):
            low, high = same[2 * i], same[2 * i + 1]
            facts[c].single, facts[c].only = low == high, low if low == high else None
    return TableFacts(rows, {f.name: facts[f.name] for f in fields}, begun)


def find_dirt(df: DataFrame, table: TableFacts, columns: list[str]) -> None:
    """Note the texts that stand for "missing" in a numeric column: six words in different cases,
    so a bounded set."""
    if columns:
        texts = [as_text(c, dtype(df, c)) for c in columns]
        row = df.agg(*[F.sort_array(F.collect_set(F.when(F.lower(x).isin(DIRTY_WORDS), x))) for x in texts]).first()
        for c, words in zip(columns, row):
            table.columns[c].dirt = words


def bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """Least and greatest finite value of numeric columns."""
    found = {}
    for start in range(0, len(columns), BATCH):
        part = columns[start : start + BATCH]
        xs = [finite(c, dtype(df, c)).cast("double") for c in part]
        row = df.agg(*[m for i, x in enumerate(xs) for m in (F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"))]).first()
        found.update({c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(part)})
    return found


def tall(df: DataFrame, columns: list[str], value, extra: dict[str, Column] | None = None) -> DataFrame:
    """Rows ``(column, value, ...)`` for the listed columns of every row."""
    more = [c.alias(n) for n, c in (extra or {}).items()]
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("value"), *more) for c in columns])))


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, value, n)`` of the non-null values as text.

    One shuffle for all columns; a value held by a third of all rows is one partial count
    per task.
    """
    names = categorical_columns(df) if columns is None else columns
    texts = tall(df, names, lambda c: as_text(c, dtype(df, c)))
    return texts.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Number of distinct non-null values per column. Texts longer than a digest are told apart
    by their SHA-256, so no long text is shuffled."""
    if not columns:
        return {}
    df = normalize_non_finite(df)
    values = tall(df, columns, lambda c: as_text(c, dtype(df, c))).filter(F.col("value").isNotNull())
    key = F.when(F.octet_length("value") <= DIGEST, F.concat(F.lit("="), F.col("value"))).otherwise(F.concat(F.lit("#"), F.sha2("value", 256)))
    rows = values.select("column", key.alias("key")).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()
    found = {r["column"]: r["n"] for r in rows}
    return {c: found.get(c, 0) for c in columns}


def together(spark: SparkSession, *jobs: Callable[[], object]) -> list:
    """Results of jobs that do not need each other, submitted at once so that none leaves
    executors idle for the others."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def duplicates(df: DataFrame) -> int:
    return duplicate_count(df).first()["duplicate_count"]


def quartiles(df: DataFrame, table: TableFacts, columns: list[str], watch: Watch | None = None) -> dict[str, list[float | None]]:
    """Exact quartiles, searched from the sketches of ``measure(..., sketch=True)``."""
    return exact_quantiles(df, columns, [0.25, 0.5, 0.75], table.starts, watch)


def quartiles_and_outliers(df: DataFrame, table: TableFacts, columns: list[str]) -> tuple[dict[str, list[float | None]], dict[str, int]]:
    """Quartiles, and how many values lie outside the fences that follow from them. Two scans; a
    third one counts the columns that could not be counted along."""
    watch = Watch(iqr_fences)
    quarts = quartiles(df, table, columns, watch)
    ends = fences(quarts)
    counts = {c: watch.count(c, b) for c, b in ends.items()}
    apart = outlier_counts(df, {c: ends[c] for c, n in counts.items() if n is None})
    return quarts, {c: apart[c] if n is None else n for c, n in counts.items()}


def fences(quarts: dict[str, list[float | None]]) -> dict[str, tuple[float, float]]:
    return {c: iqr_fences(q[0], q[2]) for c, q in quarts.items() if q[0] is not None}


def _outside(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> dict[str, Column]:
    made = {}
    for c, (low, high) in bounds.items():
        x = finite(c, dtype(df, c)).cast("double")
        made[c] = (x < F.lit(low)) | (x > F.lit(high))
    return made


def outlier_counts(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> dict[str, int]:
    tests, found = list(_outside(df, bounds).items()), {}
    for start in range(0, len(tests), BATCH):
        part = tests[start : start + BATCH]
        row = df.agg(*[F.count_if(t).alias(f"n{i}") for i, (_, t) in enumerate(part)]).first()
        found.update({c: row[f"n{i}"] for i, (c, _) in enumerate(part)})
    return found


def outlier_samples(df: DataFrame, bounds: dict[str, tuple[float, float]], order_by=None, n: int = 5) -> dict[str, list[float]]:
    """The first ``n`` outliers of each column in row order."""
    if not bounds:
        return {}
    tests = _outside(df, bounds)
    keys = F.struct(*[col(c).alias(f"k{i}") for i, c in enumerate(order_keys(df, order_by)) if not is_nested(dtype(df, c))])
    rows = tall(df, list(bounds), lambda c: F.when(tests[c], col(c).cast("double")), {"at": keys}).filter(F.col("value").isNotNull())
    first = F.row_number().over(Window.partitionBy("column").orderBy("at", "value"))
    kept = rows.withColumn("i", first).filter(F.col("i") <= n).select("column", "i", "value").collect()
    found: dict[str, list[float]] = {c: [] for c in bounds}
    for r in sorted(kept, key=lambda r: r["i"]):
        found[r["column"]].append(r["value"])
    return found
