"""Chart-ready aggregates as small DataFrames.

Aggregates use all rows. Charts that show single rows take a repeatable sample: the rows
with the smallest ``md5(seed|key)``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabwright.functions.columns import (
    as_list, as_text, categorical_columns, col, date_columns, dtype, finite, is_date, is_numeric, normalize_non_finite,
    numeric_columns, order_keys, require_columns, role,
)
from tabwright.operators import facts as fx
from tabwright.operators.grouped_quantiles import grouped_quantiles
from tabwright.operators.profile import histogram, null_counts
from tabwright.operators.quantiles import numeric_expr, quantiles_of, values_at_ranks
from tabwright.operators.scale import iqr_fences
from tabwright.session import scratch_dir

# --- fixed values ------------------------------------------------------------------
SEED = 42
KDE_POINTS = 80
BAR_VALUES, BOX_OUTLIERS, LINE_BINS, HEATMAP_ROWS = 30, 100, 2000, 200
BINS_MIN, BINS_MAX, BINS_DEFAULT = 5, 100, 20
SAMPLE_MIN, SAMPLE_MAX, SAMPLE_DEFAULT = 100, 20_000, 5_000
CHART_TYPES = [
    "histogram", "kde", "violin", "box", "outlier", "bar", "class_distribution", "scatter", "correlation_heatmap",
    "pair_plot", "grouped_box", "line", "missing_bar", "missing_heatmap",
]
# -----------------------------------------------------------------------------------

REASONS = {
    "histogram": "how the numbers are spread", "kde": "a smooth view of the same numbers", "box": "quartiles and values far from them",
    "bar": "which categories are frequent", "scatter": "how two numbers go together", "correlation_heatmap": "all pairs of numbers at a glance",
    "grouped_box": "how a number differs between categories", "missing_bar": "where values are missing", "missing_heatmap": "which rows miss them together",
}

# Values of one rank range; more values make more ranges.
RANGE_ROWS = 2_000_000
# Values that one task sorts and cuts into ranges; smaller ranges share a task and its file.
TASK_ROWS = 2_000_000
# A sum of squares that shrinks below this share when it is moved to its own mean has lost digits.
LOST_DIGITS = 0.01
# A value with more than this share of a pair's rows is hot; it is cut into parts of that share.
HOT_SHARE = 0.001


def _numeric(df: DataFrame, column: str) -> None:
    require_columns(df, [column])
    if not is_numeric(dtype(df, column)):
        raise ValueError(f"{column!r} holds no numbers, which this chart draws")


def _categorical(df: DataFrame, column: str) -> None:
    require_columns(df, [column])
    if role(dtype(df, column)) != "categorical":
        raise ValueError(f"{column!r} holds no categories, which this chart counts")


def _in_range(value: int, low: int, high: int, name: str) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} is {value}; it may lie from {low} to {high}")
    return value


def _double(df: DataFrame, column: str) -> Column:
    return finite(column, dtype(df, column)).cast("double")


def sample_rows(df: DataFrame, n: int, key: str | Sequence[str] | None = None, seed: int = SEED) -> DataFrame:
    """The ``n`` rows with the smallest seeded hash of the key.

    The n-th smallest hash is found by exact selection on its first 60 bits, so only ``n`` rows
    and those that share that hash are sorted, however many tasks there are. Missing keys hash
    as empty.
    """
    names = as_list(key) or df.columns
    require_columns(df, names)
    digest = _digest(df, names, seed)
    leading = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    size, found = values_at_ranks(df, {"h": leading}, lambda rows: [min(n, rows) - 1])["h"]
    few = df if size <= n else df.filter(leading <= F.lit(found[n - 1].value))
    return few.orderBy(digest, *[col(c) for c in order_keys(df, names)]).limit(n)


def _digest(df: DataFrame, names: list[str], seed: int = SEED) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[as_text(c, dtype(df, c)) for c in names]))


def distribution_stats(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, median, minimum and maximum of the finite values."""
    _numeric(df, column)
    x = _double(df, column)
    median = quantiles_of(df, {column: numeric_expr(df, column)}, [0.5])[column][0]
    return df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max")).select(
        "count", "mean", F.lit(median).cast("double").alias("median"), "min", "max"
    )


def chart_histogram(df: DataFrame, column: str, bins: int = BINS_DEFAULT) -> DataFrame:
    """Equal-width bins; a constant column has one bin."""
    _numeric(df, column)
    _in_range(bins, BINS_MIN, BINS_MAX, "bins")
    x = _double(df, column)
    r = df.agg(F.min(x).alias("low"), F.max(x).alias("high"), F.count(x).alias("n")).first()
    if r["n"] and r["low"] == r["high"]:
        return df.sparkSession.createDataFrame([(0, r["low"], r["low"], r["n"])], "bin bigint, bin_start double, bin_end double, count bigint")
    bounds = {column: (r["low"], r["high"])} if r["n"] else {}
    return histogram(df.select(col(column)), bounds, bins).drop("column")


def chart_kde(df: DataFrame, column: str) -> DataFrame:
    """Gaussian kernel density at 80 points between minimum and maximum.

    A task adds the values of each batch to all points at once, in one vector of 80 sums; only
    these vectors leave it.
    """
    _numeric(df, column)
    x = _double(df, column)
    r = df.agg(F.count(x).alias("n"), F.stddev_pop(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high")).first()
    if r["n"] < 2 or r["low"] == r["high"]:
        return df.sparkSession.createDataFrame([], "x double, density double")
    n, low, step = r["n"], r["low"], (r["high"] - r["low"]) / (KDE_POINTS - 1)
    width = max(1.06 * r["std"] * n ** (-1 / 5), 1e-9)
    grid = np.array([low + i * step for i in range(KDE_POINTS - 1)] + [r["high"]])
    names = [f"s{i}" for i in range(KDE_POINTS)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(KDE_POINTS)
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 1024):  # small enough for a processor's cache
                u = (grid[:, None] - values[None, at : at + 1024]) / width
                total += np.exp(-0.5 * u * u).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names)

    tasks = df.select(x.alias("v")).filter("v is not null").mapInArrow(sums, ", ".join(f"{c} double" for c in names))
    both = tasks.agg(*[F.sum(c) for c in names]).first()
    scale = n * width * math.sqrt(2 * math.pi)
    return df.sparkSession.createDataFrame([(float(g), v / scale) for g, v in zip(grid, both)], "x double, density double")


chart_violin = chart_kde


def chart_bar(df: DataFrame, column: str, k: int = BAR_VALUES) -> DataFrame:
    """The most frequent values with their share of all rows; missing ones count as "None"."""
    _categorical(df, column)
    rows = df.count()
    counts = df.groupBy(as_text(column, dtype(df, column)).alias("key")).agg(F.count(F.lit(1)).alias("count"))
    counts = counts.select(F.coalesce("key", F.lit("None")).alias("value"), "count")
    share = F.col("count") / F.lit(float(rows or 1)) * F.lit(100.0)
    return counts.select("value", "count", share.alias("percentage")).orderBy(F.desc("count"), "value").limit(k)


chart_class_distribution = chart_bar


def _box_rows(df: DataFrame, groups: dict[str, Column]) -> list[tuple]:
    """Box statistics of several expressions over one table."""
    quarts = quantiles_of(df, groups, [0.0, 0.25, 0.5, 0.75, 1.0])
    rows = []
    names = [g for g in groups if quarts[g][0] is not None]
    bounds = {g: iqr_fences(quarts[g][1], quarts[g][3]) for g in names}
    for start in range(0, len(names), fx.BATCH):
        part = names[start : start + fx.BATCH]
        found = df.agg(*[
            m for i, g in enumerate(part) for m in (
                F.count(groups[g]).alias(f"n{i}"),
                F.count_if((groups[g] < F.lit(bounds[g][0])) | (groups[g] > F.lit(bounds[g][1]))).alias(f"o{i}"),
            )
        ]).first()
        rows += [(g, found[f"n{i}"], *quarts[g], *bounds[g], found[f"o{i}"]) for i, g in enumerate(part)]
    return rows


BOX_SCHEMA = "count bigint, min double, q1 double, median double, q3 double, max double, lower_fence double, upper_fence double, outlier_count bigint"


def chart_box(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, fences and the number of values outside them."""
    _numeric(df, column)
    return df.sparkSession.createDataFrame(_box_rows(df, {column: numeric_expr(df, column)}), f"column string, {BOX_SCHEMA}")


chart_outlier = chart_box


def box_outliers(df: DataFrame, column: str, order_by=None, n: int = BOX_OUTLIERS) -> DataFrame:
    """The first ``n`` values outside the fences in row order."""
    _numeric(df, column)
    q = quantiles_of(df, {column: numeric_expr(df, column)}, [0.25, 0.75])[column]
    if q[0] is None:
        return df.select(_double(df, column).alias("value")).limit(0)
    low, high = iqr_fences(*q)
    x = _double(df, column)
    return df.filter((x < F.lit(low)) | (x > F.lit(high))).orderBy(*[col(c) for c in order_keys(df, order_by)]).limit(n).select(x.alias("value"))


def chart_grouped_box(df: DataFrame, column: str, group: str, groups: int | None = None) -> DataFrame:
    """Box statistics per category, of all categories or of the first ``groups`` by name.

    The category is a key of one exact quantile search, so the number of jobs does not depend on
    the number of categories, nothing per category comes to the driver, and a category with a
    third of the rows is never gathered in one task. Rows without category or value are left out.
    """
    _numeric(df, column)
    _categorical(df, group)
    rows = df.select(as_text(group, dtype(df, group)).alias("g"), numeric_expr(df, column).cast("double").alias("x")).filter("g is not null and x is not null")
    if groups is not None:
        rows = rows.join(rows.select("g").distinct().orderBy("g").limit(groups), "g", "left_semi")
    boxes = grouped_quantiles(rows, [0.25, 0.5, 0.75])
    iqr = F.lit(1.5) * (F.col("q2") - F.col("q0"))
    boxes = boxes.select("*", (F.col("q0") - iqr).alias("lower_fence"), (F.col("q2") + iqr).alias("upper_fence"))
    outside = (F.col("x") < F.col("lower_fence")) | (F.col("x") > F.col("upper_fence"))
    counts = rows.join(boxes.select("g", "lower_fence", "upper_fence"), "g").groupBy("g").agg(F.count_if(outside).alias("outlier_count"))
    return boxes.join(counts, "g").select(
        F.col("g").alias("group"), F.col("n").alias("count"), F.col("least").alias("min"), F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"),
        F.col("greatest").alias("max"), "lower_fence", "upper_fence", "outlier_count",
    )


def _complete(df: DataFrame, columns: list[str]) -> DataFrame:
    df = normalize_non_finite(df)
    for c in columns:
        df = df.filter(col(c).isNotNull())
    return df


def chart_scatter(df: DataFrame, x: str, y: str, sample_size: int = SAMPLE_DEFAULT, key=None) -> DataFrame:
    """Sampled complete pairs."""
    _numeric(df, x)
    _numeric(df, y)
    _in_range(sample_size, SAMPLE_MIN, SAMPLE_MAX, "sample_size")
    rows = sample_rows(_complete(df, [x, y]), sample_size, key)
    return rows.select(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def chart_pair_plot(df: DataFrame, columns: list[str], sample_size: int = SAMPLE_DEFAULT, key=None) -> DataFrame:
    """Sampled complete rows of all given numeric columns, at least two."""
    require_columns(df, columns)
    chosen = [c for c in columns if is_numeric(dtype(df, c))]
    if len(chosen) < 2:
        raise ValueError(f"a pair plot takes two columns of numbers or more; {columns} hold {len(chosen)}")
    _in_range(sample_size, SAMPLE_MIN, SAMPLE_MAX, "sample_size")
    return sample_rows(_complete(df, chosen), sample_size, key).select(*[col(c).cast("double").alias(c) for c in chosen])


def _pairs(df: DataFrame, columns: list[str]) -> list[str]:
    require_columns(df, columns)
    chosen = [c for c in columns if is_numeric(dtype(df, c))]
    if len(chosen) < 2:
        raise ValueError(f"a correlation takes two columns of numbers or more; {columns} hold {len(chosen)}")
    return chosen


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson r of two columns over all complete pairs."""
    _numeric(df, x)
    _numeric(df, y)
    both = df.select(_double(df, x).alias("a"), _double(df, y).alias("b")).filter("a is not null and b is not null")
    low_high = both.agg(F.min("a").alias("al"), F.max("a").alias("ah"), F.min("b").alias("bl"), F.max("b").alias("bh")).first()
    if low_high["al"] is None or low_high["al"] == low_high["ah"] or low_high["bl"] == low_high["bh"]:
        return both.agg(F.lit(None).cast("double").alias("correlation"))
    return both.agg(F.corr("a", "b").alias("correlation"))


def _heatmap(df: DataFrame, chosen: list[str], values: dict[tuple[str, str], float | None]) -> DataFrame:
    rows = [(x, y, values[(x, y)] if (x, y) in values else values[(y, x)]) for y in chosen for x in chosen]
    return df.sparkSession.createDataFrame(rows, "x string, y string, value double")


def _pair_sums(narrow: DataFrame, middles: list[float]) -> dict[int, tuple]:
    """``(n, x, y, xx, yy, xy)`` per pair of columns, diagonal included: how many rows hold both,
    and sums over them of the distances from ``middles``, of their squares and products.

    A task adds up whole batches as products of matrices; one row per pair leaves it.
    """
    k, center = len(middles), np.array(middles)[:, None]
    first, second = np.triu_indices(k)
    names = ["n", "x", "y", "xx", "yy", "xy"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q, c = np.zeros((4, k, k))
        for batch in batches:
            values = np.array([column.to_numpy(zero_copy_only=False) for column in batch.columns])
            for at in range(0, batch.num_rows, 4096):  # small enough for a processor's cache
                x = values[:, at : at + 4096] - center
                missing = np.isnan(x)
                x[missing] = 0.0
                here = (~missing).astype(float).T
                n += here.T @ here
                s += x @ here
                q += (x * x) @ here
                c += x @ x.T
        found = [n[first, second], s[first, second], s[second, first], q[first, second], q[second, first], c[first, second]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(first))), *map(pa.array, found)], ["pair", *names])

    tasks = narrow.mapInArrow(sums, ", ".join(["pair bigint", *(f"{c} double" for c in names)]))
    return {r["pair"]: tuple(r)[1:] for r in tasks.groupBy("pair").agg(*[F.sum(c).alias(c) for c in names]).collect()}


def _around_means(narrow: DataFrame, pairs: list[tuple[int, int]]) -> dict[tuple[int, int], float | None]:
    """Pearson r of pairs of columns, each around the means of its own complete rows."""
    values = {}
    for start in range(0, len(pairs), fx.BATCH):
        part, aggs = pairs[start : start + fx.BATCH], []
        for i, (a, b) in enumerate(part):
            x, y = F.when(F.col(f"v{b}").isNotNull(), F.col(f"v{a}")), F.when(F.col(f"v{a}").isNotNull(), F.col(f"v{b}"))
            aggs += [F.covar_pop(x, y).alias(f"c{i}"), F.stddev_pop(x).alias(f"s{i}"), F.stddev_pop(y).alias(f"t{i}")]
        r = narrow.agg(*aggs).first()
        for i, (a, b) in enumerate(part):
            spread = (r[f"s{i}"] or 0.0) * (r[f"t{i}"] or 0.0)
            values[a, b] = None if not spread else 1.0 if a == b else r[f"c{i}"] / spread
    return values


def chart_corr_pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise Pearson correlation of all given columns over the complete rows of each pair.

    Two scans for all pairs: one for the means, one for sums around them, which keep the precision
    that raw products would lose. Pairs whose complete rows lie far from the means, compared with
    how they spread, are measured again around means of their own.
    """
    chosen = _pairs(df, columns)
    narrow = df.select(*[_double(df, c).alias(f"v{i}") for i, c in enumerate(chosen)])
    of = range(len(chosen))
    r = narrow.agg(*[m for i in of for m in (F.avg(f"v{i}").alias(f"m{i}"), (F.min(f"v{i}") < F.max(f"v{i}")).alias(f"d{i}"))]).first()
    varies = [bool(r[f"d{i}"]) for i in of]
    found = _pair_sums(narrow, [r[f"m{i}"] or 0.0 for i in of]) if any(varies) else {}
    values, again = {}, []
    for at, (i, j) in enumerate(itertools.combinations_with_replacement(of, 2)):
        n, x, y, xx, yy, xy = found.get(at, (0,) * 6)
        values[i, j] = None
        if not varies[i] or not varies[j] or not n:
            continue
        sx, sy = xx - x * x / n, yy - y * y / n
        if sx > LOST_DIGITS * xx and sy > LOST_DIGITS * yy:
            values[i, j] = 1.0 if i == j else (xy - x * y / n) / (math.sqrt(sx) * math.sqrt(sy))
        else:
            again.append((i, j))
    values.update(_around_means(narrow, again))
    return _heatmap(df, chosen, {(chosen[i], chosen[j]): v for (i, j), v in values.items()})


def _side_counts(pairs: DataFrame) -> DataFrame:
    """``(p, side, value, n)``: how often each value occurs on each side of each pair."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("value")), F.struct(F.lit(1).alias("side"), F.col("b").alias("value")))
    return pairs.select("p", "n", F.inline(sides)).groupBy("p", "side", "value").agg(F.sum("n").alias("n"))


def _average_ranks(counts: DataFrame) -> DataFrame:
    """``(p, side, value, rank)``: the average rank of each distinct value in its range, plus
    the rows in earlier ranges. A hot value is one row here, whatever its count."""
    upto = F.sum("n").over(Window.partitionBy("p", "side", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    average = F.col("passed") + upto - F.col("n") + (F.col("n") + F.lit(1)) / F.lit(2.0)
    return counts.withColumn("rank", average.cast("double")).select("p", "side", "value", "rank")


def _ranged_counts(counts: DataFrame, rows: int, range_rows: int) -> DataFrame:
    """The counts cut into sorted ranges of at most ``range_rows`` values, each with the rows before it.

    Spark's range partitioning deals the values out to tasks of about ``TASK_ROWS`` values, and each
    task numbers its sorted values, so the number of tasks and files does not grow as ranges get
    smaller. The cuts differ from job to job, so the ranges are written once to the shared scratch
    folder and read from there.
    """
    path = scratch_dir(counts.sparkSession, "ranks")
    keys = ["p", "side", "value"]
    dealt = counts.repartitionByRange(max(1, -(-rows // max(range_rows, TASK_ROWS))), *keys).sortWithinPartitions(*keys)
    # Ids of one task are consecutive and far from those of the next one.
    cut = dealt.withColumn("id", F.monotonically_increasing_id()).withColumn("range", F.expr(f"id DIV {range_rows}")).drop("id")
    cut.write.parquet(path)
    stored = counts.sparkSession.read.schema(cut.schema).parquet(path)
    # One row per range and side.
    sizes = stored.groupBy("p", "side", "range").agg(F.sum("n").alias("size"))
    before = F.sum("size").over(Window.partitionBy("p", "side").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    return stored.join(sizes.select("p", "side", "range", F.coalesce(before, F.lit(0)).alias("passed")), ["p", "side", "range"])


def _with_rank(pairs: DataFrame, ranks: DataFrame, hot: DataFrame, side: int) -> DataFrame:
    """Attach the average rank of one side. Rows of a hot value are salted by the other side, into
    as many parts as the value has shares of its pair."""
    name, other, rank = ("a", "b", "ra") if side == 0 else ("b", "a", "rb")
    mine = ranks.filter(F.col("side") == side).select("p", F.col("value").alias(name), F.col("rank").alias(rank))
    parts = F.broadcast(hot.filter(F.col("side") == side).select("p", F.col("value").alias(name), "parts"))
    salt = F.coalesce(F.pmod(F.xxhash64(other), F.col("parts")), F.lit(0))
    left = pairs.join(parts, ["p", name], "left").withColumn("salt", salt).drop("parts")
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)).cast("bigint") - F.lit(1))
    right = mine.join(parts, ["p", name], "left").withColumn("salt", F.explode(copies)).drop("parts")
    return left.join(right, ["p", name, "salt"]).drop("salt")


def spearman(df: DataFrame, chosen: list[tuple[str, str]], range_rows: int = RANGE_ROWS) -> dict[tuple[str, str], float | None]:
    """Correlation of average ranks over the complete rows of each pair of columns.

    Equal pairs are counted first; distinct values are ranked in ranges of at most ``range_rows``
    values. The one broadcast holds the hot values, at most 1 / HOT_SHARE per side of a pair.
    """
    names = list(dict.fromkeys(c for pair in chosen for c in pair))
    narrow = df.select(*[_double(df, c).alias(f"v{i}") for i, c in enumerate(names)])
    each = [F.struct(F.lit(i).alias("p"), F.col(f"v{names.index(x)}").alias("a"), F.col(f"v{names.index(y)}").alias("b")) for i, (x, y) in enumerate(chosen)]
    complete = narrow.select(F.inline(F.array(*each))).filter("a is not null and b is not null")
    seen = complete.groupBy("p").agg(F.count(F.lit(1)).alias("n"), ((F.min("a") < F.max("a")) & (F.min("b") < F.max("b"))).alias("varies"))
    sizes = {r["p"]: r["n"] for r in seen.collect() if r["varies"]}
    if not sizes:
        return dict.fromkeys(chosen)
    # Equal pairs travel as one row from here on.
    pairs = complete.filter(F.col("p").isin(list(sizes))).groupBy("p", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    stored = _ranged_counts(_side_counts(pairs), 2 * sum(sizes.values()), range_rows)
    total = F.create_map(*[F.lit(x) for item in sizes.items() for x in item])[F.col("p")]
    share = F.greatest(total * F.lit(HOT_SHARE), F.lit(1.0))
    hot = stored.filter(F.col("n") > share).select("p", "side", "value", F.ceil(F.col("n") / share).alias("parts"))
    ranks = _average_ranks(stored)
    ranked = _with_rank(_with_rank(pairs, ranks, hot, 0), ranks, hot, 1)
    middle = F.lit(0.0)
    for p, n in sizes.items():
        middle = F.when(F.col("p") == p, F.lit((n + 1) / 2.0)).otherwise(middle)
    da, db, n = F.col("ra") - middle, F.col("rb") - middle, F.col("n")
    sums = ranked.groupBy("p").agg(F.sum(n * da * db).alias("ab"), F.sum(n * da * da).alias("aa"), F.sum(n * db * db).alias("bb")).collect()
    found = {r["p"]: r["ab"] / math.sqrt(r["aa"] * r["bb"]) for r in sums}
    return {pair: found.get(i) for i, pair in enumerate(chosen)}


def chart_corr_spearman(df: DataFrame, columns: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Pairwise Spearman correlation of all given columns."""
    chosen = _pairs(df, columns)
    values = spearman(df, list(itertools.combinations(chosen, 2)), range_rows)
    x = {c: _double(df, c) for c in chosen}
    r = df.agg(*[(F.min(x[c]) < F.max(x[c])).alias(f"v{i}") for i, c in enumerate(chosen)]).first()
    values.update({(c, c): 1.0 if r[f"v{i}"] else None for i, c in enumerate(chosen)})
    return _heatmap(df, chosen, values)


def chart_line(df: DataFrame, x: str, y: str, bins: int = LINE_BINS) -> DataFrame:
    """The whole line in up to ``bins`` equal stretches of x: one row per stretch that holds points.

    ``(bin, x_first, x_last, count, y_first, y_last, y_min, y_max, y_mean)`` is what a line drawn
    through all points needs at that width: where it enters and leaves a stretch and how far it
    swings there. Of points with one x the least y is the first and the greatest the last. Rows
    without x or y are no points; equal xs make one stretch. Two scans; each task sends one
    row per stretch.
    """
    require_columns(df, [x, y])
    if not (is_numeric(dtype(df, x)) or is_date(dtype(df, x))) or not is_numeric(dtype(df, y)):
        raise ValueError(f"A line needs numbers or dates in {x!r} and numbers in {y!r}")
    _in_range(bins, 1, SAMPLE_MAX, "bins")
    points = _complete(df, [x, y]).select(col(x).alias("x"), col(y).cast("double").alias("y"))
    kind = dtype(points, "x")
    at = F.col("x").cast("double")
    if is_date(kind):
        at = (F.unix_date("x") if kind.typeName() == "date" else F.unix_micros(F.col("x").cast("timestamp"))).cast("double")
    points = points.withColumn("at", at)
    ends = points.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
    low, width = ends["low"] or 0.0, ((ends["high"] or 0.0) - (ends["low"] or 0.0)) / bins
    number = F.least(F.floor((F.col("at") - F.lit(low)) / F.lit(width)), F.lit(bins - 1).cast("bigint")) if width else F.lit(0).cast("bigint")
    point = F.struct("x", "y")
    drawn = points.groupBy(number.alias("bin")).agg(
        F.min(point).alias("first"), F.max(point).alias("last"), F.count(F.lit(1)).alias("count"),
        F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.avg("y").alias("y_mean"),
    )
    return drawn.select(
        "bin", F.col("first.x").alias("x_first"), F.col("last.x").alias("x_last"), "count",
        F.col("first.y").alias("y_first"), F.col("last.y").alias("y_last"), "y_min", "y_max", "y_mean",
    )


def line_points(df: DataFrame, x: str, y: str, n: int = LINE_BINS) -> DataFrame:
    """The first ``n`` points by x: the start of a line, point by point."""
    require_columns(df, [x, y])
    points = _complete(df, [x, y]).select(col(x).alias("x"), col(y).cast("double").alias("y"))
    return points.orderBy("x", "y").limit(n)


def chart_missing_bar(df: DataFrame) -> DataFrame:
    return null_counts(df).withColumnsRenamed({"missing_count": "missing", "missing_percentage": "percentage"})


def chart_missing_heatmap(df: DataFrame, n: int = HEATMAP_ROWS, key=None) -> DataFrame:
    """``(row, column, missing)`` of up to ``n`` sampled rows."""
    _in_range(n, 1, SAMPLE_MAX, "n")
    df = normalize_non_finite(df)
    names = df.columns
    flags = [F.struct(F.lit(c).alias("column"), col(c).isNull().alias("missing")) for c in names]
    sampled = sample_rows(df, n, key)
    digest = _digest(df, as_list(key) or names)
    # At most SAMPLE_MAX rows are numbered here.
    order = Window.orderBy(digest, *[col(c) for c in order_keys(df, key)])
    numbered = sampled.withColumn("__row", F.row_number().over(order) - F.lit(1))
    return numbered.select(F.col("__row").cast("bigint").alias("row"), F.inline(F.array(*flags)))


def chart_metadata(df: DataFrame) -> DataFrame:
    """Role and missing count of every column."""
    roles = [(i, f.name, role(f.dataType)) for i, f in enumerate(df.schema)]
    table = fx.measure(df, detail=False)
    rows = [(i, c, r, table.missing(c)) for i, c, r in roles]
    return df.sparkSession.createDataFrame(rows, "position bigint, column string, role string, missing_count bigint")


def chart_recommendations(df: DataFrame) -> DataFrame:
    """Charts that suit the column roles, each with the reason."""
    numbers, texts = numeric_columns(df), categorical_columns(df)
    table = fx.measure(df, detail=False)
    out: list[tuple[str, list[str]]] = []
    if numbers:
        out += [(kind, numbers[:1]) for kind in ("histogram", "kde", "box")]
    if texts:
        out.append(("bar", texts[:1]))
    if len(numbers) >= 2:
        out += [("scatter", numbers[:2]), ("correlation_heatmap", numbers)]
    if numbers and texts:
        out.append(("grouped_box", [numbers[0], texts[0]]))
    if any(table.missing(c) for c in df.columns):
        out += [("missing_bar", []), ("missing_heatmap", [])]
    rows = [(i, kind, ",".join(names), REASONS[kind]) for i, (kind, names) in enumerate(out, 1)]
    return df.sparkSession.createDataFrame(rows, "rank bigint, chart_type string, columns string, reason string")


def generate_chart(
    df: DataFrame, chart_type: str, columns: Sequence[str] = (), x_column: str | None = None, y_column: str | None = None,
    group_column: str | None = None, bins: int = BINS_DEFAULT, correlation_method: str = "pearson", sample_size: int = SAMPLE_DEFAULT,
    key=None,
) -> DataFrame:
    """A chart by name. Columns are taken in the order columns, x, y, group."""
    if chart_type not in CHART_TYPES:
        raise ValueError(f"there is no chart {chart_type!r}; known are {', '.join(CHART_TYPES)}")
    chosen = [c for c in (*columns, x_column, y_column, group_column) if c]
    require_columns(df, chosen)
    needed = {"scatter": 2, "grouped_box": 2, "line": 2, "pair_plot": 2, "correlation_heatmap": 2, "missing_bar": 0, "missing_heatmap": 0}.get(chart_type, 1)
    if len(chosen) < needed:
        raise ValueError(f"{chart_type} takes {needed} columns; {len(chosen)} were given")
    if chart_type == "histogram":
        return chart_histogram(df, chosen[0], bins)
    if chart_type in ("kde", "violin"):
        return chart_kde(df, chosen[0])
    if chart_type in ("box", "outlier"):
        return chart_box(df, chosen[0])
    if chart_type in ("bar", "class_distribution"):
        return chart_bar(df, chosen[0])
    if chart_type == "scatter":
        return chart_scatter(df, chosen[0], chosen[1], sample_size, key)
    if chart_type == "correlation_heatmap":
        if correlation_method not in ("pearson", "spearman"):
            raise ValueError(f"correlation_method is {correlation_method!r}; known are pearson and spearman")
        return (chart_corr_pearson if correlation_method == "pearson" else chart_corr_spearman)(df, chosen)
    if chart_type == "pair_plot":
        return chart_pair_plot(df, chosen, sample_size, key)
    if chart_type == "grouped_box":
        return chart_grouped_box(df, chosen[0], chosen[1])
    if chart_type == "line":
        return chart_line(df, chosen[0], chosen[1])
    if chart_type == "missing_bar":
        return chart_missing_bar(df)
    return chart_missing_heatmap(df, sample_size, key)
