"""Column profiles, quality issues and the health score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwright.functions.columns import as_text, categorical_columns, col, date_columns, dtype, normalize_non_finite, numeric_columns
from tabwright.operators import facts as fx
from tabwright.operators.facts import ColumnFacts, TableFacts, percentage
from tabwright.session import scratch_dir

# --- fixed values: thresholds of the quality rules -------------------------------------
MISSING_WARNING, MISSING_CRITICAL = 30.0, 60.0
DUPLICATE_CRITICAL = 15.0
MIXED_SHARE, DATE_SHARE = 0.6, 0.7
MISSING_WEIGHT, MISSING_CAP = 0.8, 30.0
DUPLICATE_WEIGHT, DUPLICATE_CAP = 1.5, 25.0
PENALTY = {"critical": 10.0, "warning": 4.0}
# ---------------------------------------------------------------------------------------

HEAD = 64  # characters of a text that are counted as they are
SAMPLES = 5  # words shown of a mixed column
ACTIONS = {
    "DUPLICATE_ROWS": "keep one row of each group of copies",
    "HIGH_MISSINGNESS": "fill the gaps, or leave the column out",
    "OUTLIERS_DETECTED": "check the extreme values, then clip or remove them",
    "CONSTANT_COLUMN": "drop the column: it tells rows apart in nothing",
    "MIXED_DATA_TYPES": "cast the column to a number and let other texts become missing",
}

ISSUE_SCHEMA = "code string, severity string, column string, affected_rows bigint, sample_values string, suggested_action string"


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column, one aggregation."""
    df = normalize_non_finite(df)
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("missing_count")) for i, c in enumerate(df.columns)]
    share = F.coalesce(F.try_divide(F.col("missing_count"), F.col("rows")) * F.lit(100.0), F.lit(0.0))
    return one.select("rows", F.inline(F.array(*parts))).select("column", "missing_count", share.alias("missing_percentage"))


def profile_table(df: DataFrame, table: TableFacts | None = None, copies: int | None = None) -> DataFrame:
    """Size, duplicates and missing cells, one row."""
    table = table or fx.measure(df, detail=False)
    copies = fx.duplicates(df) if copies is None else copies
    holes = sum(table.missing(c) for c in table.columns)
    row = (table.rows, len(table.columns), copies, percentage(copies, table.rows), holes, percentage(holes, table.rows * len(table.columns)))
    return df.sparkSession.createDataFrame(
        [row],
        "row_count bigint, column_count bigint, duplicate_row_count bigint, duplicate_row_percentage double, "
        "total_missing_values bigint, total_missing_percentage double",
    )


def profile_numeric(df: DataFrame, table: TableFacts | None = None, quarts: dict | None = None) -> DataFrame:
    """One row per numeric column; a column without values has no statistics and counts as constant."""
    names = numeric_columns(df)
    table = table or fx.measure(df.select(*[col(c) for c in names]), sketch=True)
    quarts = fx.quartiles(df, table, names) if quarts is None else quarts
    rows = []
    for c in names:
        f, (q25, median, q75) = table.columns[c], quarts[c]
        rows.append((
            c, f.type.simpleString(), table.rows, table.missing(c), percentage(table.missing(c), table.rows),
            f.mean, median, f.std, f.low, f.high, q25, q75, None if q25 is None else q75 - q25, f.single,
        ))
    return df.sparkSession.createDataFrame(
        rows,
        "column string, inferred_type string, count bigint, missing_count bigint, missing_percentage double, mean double, median double, "
        "std double, min double, max double, q25 double, q75 double, iqr double, is_constant boolean",
    )


def constant_numeric(df: DataFrame) -> DataFrame:
    """Whether all values of a numeric column are equal, missing ones aside; one aggregation."""
    df = normalize_non_finite(df)
    names = numeric_columns(df)
    one = df.agg(*[F.coalesce(F.min(col(c)) == F.max(col(c)), F.lit(True)).alias(f"c{i}") for i, c in enumerate(names)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("is_constant")) for i, c in enumerate(names)])))


def iqr_outliers(df: DataFrame, order_by=None) -> DataFrame:
    """Values outside the 1.5 IQR fences per numeric column, with the first five of them."""
    names = numeric_columns(df)
    table = fx.measure(df.select(*[col(c) for c in names]), detail=False, sketch=True)
    quarts, counts = fx.quartiles_and_outliers(df, table, names)
    bounds, present = fx.fences(quarts), table.columns
    samples = fx.outlier_samples(df, bounds, order_by)
    rows = []
    for c in bounds:
        five = (samples[c] + [None] * 5)[:5]
        rows.append((c, *bounds[c], counts[c], percentage(counts[c], present[c].present), *five))
    return df.sparkSession.createDataFrame(
        rows,
        "column string, lower_bound double, upper_bound double, outlier_count bigint, outlier_percentage double, "
        + ", ".join(f"sample_{i} double" for i in range(1, 6)),
    )


def _edge_fixed(x: Column, i: Column, low: float, width: float, bins: int) -> Column:
    """The bin of a value from its rounded quotient, moved by one where the quotient next to
    an edge fell on the wrong side."""
    lo, w, last = F.lit(low), F.lit(width), F.lit(bins - 1).cast("bigint")
    return F.when(x < lo + i * w, i - F.lit(1)).when((i < last) & (x >= lo + (i + F.lit(1)) * w), i + F.lit(1)).otherwise(i)


def binned(df: DataFrame, bounds: dict[str, tuple[float, float]], bins: int) -> DataFrame:
    """``(column, bin)`` of every value in equal-width bins; the last bin is closed."""
    df = normalize_non_finite(df)
    last = F.lit(bins - 1).cast("bigint")
    width = {c: (high - low) / bins for c, (low, high) in bounds.items()}
    xs = df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(bounds)])
    quotient = [F.least(F.floor((F.col(f"x{i}") - F.lit(bounds[c][0])) / F.lit(width[c])), last).alias(f"q{i}") for i, c in enumerate(bounds)]
    both = xs.select("*", *quotient)
    parts = []
    for i, c in enumerate(bounds):
        x = F.col(f"x{i}")  # least skips nulls, so a missing value has a quotient
        fixed = F.when(x.isNotNull(), _edge_fixed(x, F.col(f"q{i}"), bounds[c][0], width[c], bins))
        parts.append(F.struct(F.lit(i).alias("c"), fixed.alias("bin")))
    return both.select(F.inline(F.array(*parts))).filter("bin is not null")


def histogram(df: DataFrame, bounds: dict[str, tuple[float, float]], bins: int) -> DataFrame:
    """``(column, bin, bin_start, bin_end, count)``, empty bins included."""
    schema = "column string, bin bigint, bin_start double, bin_end double, count bigint"
    empty = []
    names = list(bounds)
    for c, (low, high) in bounds.items():
        width = (high - low) / bins
        edges = [low + i * width for i in range(bins)] + [high]
        empty += [(c, i, edges[i], edges[i + 1], 0) for i in range(bins)]
    frame = df.sparkSession.createDataFrame(empty, schema)
    if not bounds:
        return frame
    counts = binned(df, bounds, bins).groupBy("c", "bin").agg(F.count(F.lit(1)).alias("count"))
    named = counts.select(F.element_at(F.array(*[F.lit(c) for c in names]), F.col("c") + F.lit(1)).alias("column"), "bin", "count")
    none = F.lit(None).cast("double")
    both = frame.unionByName(named.select("column", "bin", none.alias("bin_start"), none.alias("bin_end"), "count"))
    return both.groupBy("column", "bin").agg(F.max("bin_start").alias("bin_start"), F.max("bin_end").alias("bin_end"), F.sum("count").alias("count"))


def profile_histogram(df: DataFrame, bins: int = 10, table: TableFacts | None = None) -> DataFrame:
    """Ten bins per numeric column; constant columns have none."""
    names = numeric_columns(df)
    if table is None:
        ends = fx.bounds(df, names)
    else:
        ends = {c: (table.columns[c].low, table.columns[c].high) for c in names}
    return histogram(df, {c: e for c, e in ends.items() if e[0] is not None and e[0] < e[1]}, bins)


def profile_dates(df: DataFrame, table: TableFacts | None = None) -> DataFrame:
    """Date columns, and text columns most of whose values look like dates."""
    table = table or fx.measure(df)
    rows = []
    for c in df.columns:
        f = table.columns[c]
        missing = table.missing(c)
        if c in date_columns(df):
            rows.append((c, f.type.simpleString(), table.rows, missing, percentage(missing, table.rows), f.present, 0, f.first_text, f.last_text))
        elif is_date_text(f):
            rows.append((c, "string_as_date", table.rows, missing, percentage(missing, table.rows), f.date_looks, f.present - f.date_looks, None, None))
    return df.sparkSession.createDataFrame(
        rows,
        "column string, inferred_type string, count bigint, missing_count bigint, missing_percentage double, valid_date_count bigint, "
        "invalid_date_count bigint, min_date string, max_date string",
    )


def is_date_text(f: ColumnFacts) -> bool:
    return f.present > 0 and f.date_looks / f.present > DATE_SHARE


def is_mixed(f: ColumnFacts) -> bool:
    return f.present > 0 and f.numeric_looks / f.present > MIXED_SHARE and f.numeric_looks < f.present


def _text_facts(df: DataFrame) -> TableFacts:
    return fx.measure(df.select(*[col(c) for c in categorical_columns(df)]))


def date_string_check(df: DataFrame) -> DataFrame:
    """How many values of each text column look like dates."""
    table = _text_facts(df)
    rows = [(c, f.present, f.date_looks, f.present - f.date_looks, is_date_text(f)) for c, f in table.columns.items()]
    return df.sparkSession.createDataFrame(rows, "column string, non_null_count bigint, valid_date_count bigint, invalid_date_count bigint, string_as_date boolean")


def mixed_type_check(df: DataFrame) -> DataFrame:
    """How many values of each text column look like numbers."""
    table = _text_facts(df)
    fx.find_dirt(df, table, list(table.columns))
    rows = [(c, f.present, f.numeric_looks, is_mixed(f), table.rows - f.numeric_looks, "|".join(f.dirt[:SAMPLES])) for c, f in table.columns.items()]
    return df.sparkSession.createDataFrame(rows, "column string, non_null_count bigint, numeric_looks bigint, is_mixed boolean, affected_rows bigint, dirty_samples string")


def profile_categorical(df: DataFrame, table: TableFacts | None = None, distinct: dict[str, int] | None = None) -> DataFrame:
    """Text, boolean and nested columns: distinct values and their share of all rows."""
    names = categorical_columns(df)
    table = table or fx.measure(df.select(*[col(c) for c in names]), detail=False)
    distinct = distinct or fx.distinct_counts(df, names)
    rows = []
    for c in names:
        missing = table.missing(c)
        ratio = distinct[c] / table.rows if table.rows else 0.0
        rows.append((c, table.columns[c].type.simpleString(), table.rows, missing, percentage(missing, table.rows), distinct[c], ratio, distinct[c] == 1 and missing == 0))
    return df.sparkSession.createDataFrame(
        rows,
        "column string, inferred_type string, count bigint, missing_count bigint, missing_percentage double, unique_count bigint, "
        "cardinality_ratio double, is_constant boolean",
    )


def top_values(df: DataFrame, k: int = 10, columns: list[str] | None = None) -> DataFrame:
    """The ``k`` most frequent values per categorical column with their share of all rows; of
    equally frequent ones the greatest.

    A text of more than HEAD characters is counted by its first HEAD characters and its SHA-256,
    so long texts are not shuffled. Only the texts of the winners, and of those that tie with the
    last one in count and first characters, are read again. The rank filter is applied before
    the shuffle as well, so no task sees all distinct values of a column.
    """
    df = normalize_non_finite(df)
    names = categorical_columns(df) if columns is None else columns
    rows = df.count()
    values = fx.tall(df, names, lambda c: as_text(c, dtype(df, c))).filter(F.col("value").isNotNull())
    keyed = values.select("column", F.substring("value", 1, HEAD).alias("head"), F.when(F.length("value") > HEAD, F.sha2("value", 256)).alias("digest"), "value")
    counts = keyed.groupBy("column", "head", "digest").agg(F.count(F.lit(1)).alias("n"))
    # A text that ends with its head is the least of those that begin with it.
    place = F.rank().over(Window.partitionBy("column").orderBy(F.desc("n"), F.desc("head"), F.col("digest").isNull()))
    path = scratch_dir(df.sparkSession, "frequent")
    counts.withColumn("place", place).filter(F.col("place") <= k).drop("place").write.parquet(path)
    winners = df.sparkSession.read.schema("column string, head string, digest string, n bigint").parquet(path)
    found = winners.filter("digest is null").select("column", "head", "n", F.col("head").alias("value"))
    long = winners.filter("digest is not null")
    wanted = [r["column"] for r in long.select("column").distinct().collect()]
    if wanted:
        texts = keyed.filter(F.col("column").isin(wanted) & F.col("digest").isNotNull()).join(long, ["column", "head", "digest"])
        found = found.unionByName(texts.groupBy("column", "head", "digest", "n").agg(F.max("value").alias("value")).drop("digest"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), F.desc("value")))
    share = F.col("n") / F.lit(float(rows or 1)) * F.lit(100.0)
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("column", F.col("rank").cast("bigint").alias("rank"), "value", F.col("n").alias("count"), share.alias("percentage"))


@dataclass
class Measured:
    """Everything the quality rules look at."""

    table: TableFacts
    copies: int
    outliers: dict[str, int]
    quarts: dict[str, list[float | None]]
    distinct: dict[str, int]


def measure_all(df: DataFrame) -> Measured:
    """Numbers are read three times, texts once, and once more if they may be constant or are
    mixed; copies of rows are counted apart."""
    def numbers_and_texts() -> tuple:
        table = fx.measure(df, sketch=True)
        mixed = [c for c, f in table.columns.items() if is_mixed(f)]
        return table, *fx.together(df.sparkSession, lambda: fx.quartiles_and_outliers(df, table, numeric_columns(df)), lambda: fx.find_dirt(df, table, mixed))

    (table, (quarts, outliers), _), copies = fx.together(df.sparkSession, numbers_and_texts, lambda: fx.duplicates(df))
    return Measured(table, copies, outliers, quarts, {})


def issue_rows(m: Measured) -> list[tuple]:
    """``(code, severity, column, affected rows, sample values)``. Samples are the value of a
    constant column, the words for "missing" among numbers, and of outliers the least and the
    greatest value as far as they lie outside the fences."""
    t, out = m.table, []
    if m.copies:
        share = percentage(m.copies, t.rows, 2)
        out.append(("DUPLICATE_ROWS", "warning" if share < DUPLICATE_CRITICAL else "critical", None, m.copies, []))
    ends = fx.fences(m.quarts)
    for c, f in t.columns.items():
        share = percentage(t.missing(c), t.rows, 2)
        if share > MISSING_WARNING:
            out.append(("HIGH_MISSINGNESS", "critical" if share > MISSING_CRITICAL else "warning", c, t.missing(c), []))
        if m.outliers.get(c):
            out.append(("OUTLIERS_DETECTED", "warning", c, m.outliers[c], [f"{v:.2f}" for v in (f.low, f.high) if v < ends[c][0] or v > ends[c][1]]))
        if c in m.quarts:
            constant, value = f.present > 0 and f.single, None if f.low is None else f"{f.low:.2f}"
        else:
            constant, value = f.first_text is None and f.present > 0 and f.single and t.missing(c) == 0, f.only
        if constant:
            out.append(("CONSTANT_COLUMN", "warning", c, t.rows, [] if value is None else [value]))
        if is_mixed(f):
            out.append(("MIXED_DATA_TYPES", "critical", c, t.rows - f.numeric_looks, f.dirt[:SAMPLES]))
    return out


def score(m: Measured) -> float:
    t = m.table
    holes = sum(t.missing(c) for c in t.columns)
    missing = percentage(holes, max(t.rows * len(t.columns), 1), 2)
    penalty = min(missing * MISSING_WEIGHT, MISSING_CAP) + min(percentage(m.copies, t.rows, 2) * DUPLICATE_WEIGHT, DUPLICATE_CAP)
    penalty += sum(PENALTY.get(row[1], 0.0) for row in issue_rows(m))
    return max(0.0, min(100.0, round(100.0 - penalty, 1)))


def quality_issues(df: DataFrame, m: Measured | None = None) -> DataFrame:
    """``(code, severity, column, affected_rows, sample_values, suggested_action)``; samples are
    joined by a bar."""
    rows = [(*r[:4], "|".join(r[4]), ACTIONS[r[0]]) for r in issue_rows(m or measure_all(df))]
    return df.sparkSession.createDataFrame(rows, ISSUE_SCHEMA)


def health_score(df: DataFrame, m: Measured | None = None) -> DataFrame:
    """The 0 to 100 score with the parts it comes from, one row."""
    m = m or measure_all(df)
    issues = issue_rows(m)
    holes = sum(m.table.missing(c) for c in m.table.columns)
    row = (
        percentage(holes, max(m.table.rows * len(m.table.columns), 1), 2), percentage(m.copies, m.table.rows, 2),
        sum(r[1] == "critical" for r in issues), sum(r[1] == "warning" for r in issues), score(m),
    )
    return df.sparkSession.createDataFrame([row], "missing_percentage double, duplicate_percentage double, critical_issues bigint, warning_issues bigint, health_score double")


def profile(df: DataFrame, order_by=None) -> dict[str, DataFrame]:
    """The whole profile as small DataFrames, measured once."""
    m = measure_all(df)
    m.distinct = fx.distinct_counts(df, categorical_columns(df))
    return {
        "table": profile_table(df, m.table, m.copies),
        "numeric": profile_numeric(df, m.table, m.quarts),
        "histogram": profile_histogram(df, 10, m.table),
        "dates": profile_dates(df, m.table),
        "categorical": profile_categorical(df, m.table, m.distinct),
        "top_values": top_values(df),
        "issues": quality_issues(df, m),
        "score": health_score(df, m),
    }
