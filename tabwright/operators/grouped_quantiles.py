"""Exact order statistics of every group of a column, in a number of jobs that does not depend on
how many groups there are.

A sketch per group bounds the values at the wanted ranks; the bounds are a written table with
one row per group, which the rows are joined to. Each round counts, for every group at once, the
values below, on and between its bounds. Where few enough lie between, these are counted one by
one and the rank is picked among them; else a sketch of what lies between gives closer bounds.
A group with a third of all rows is pre-aggregated in every task, and no task sees more than
``COLLECT_LIMIT`` values of one rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwright.session import scratch_dir

GRID_STEPS, MARGIN = 401, 6  # quantiles taken from a sketch; steps that its error may reach
SKETCH_SIZE = 512
COLLECT_LIMIT = 20_000

_GRID = "cast(split('" + " ".join(str(i / GRID_STEPS) for i in range(GRID_STEPS + 1)) + "', ' ') as array<double>)"


def _written(df: DataFrame, purpose: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _grid(x: Column) -> Column:
    return F.when(F.count(x) > 0, F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(x, F.lit(SKETCH_SIZE)), F.expr(_GRID)))


def _step(grid: Column, rank: Column, size: Column, move: int) -> Column:
    """The grid value some steps before or behind the place of a rank among ``size`` values."""
    at = F.floor(rank / size * F.lit(float(GRID_STEPS))) + F.lit(move)
    return F.element_at(grid, (F.greatest(F.lit(0), F.least(F.lit(GRID_STEPS), at)) + F.lit(1)).cast("int"))


def _counted(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """``bounds (g, t, rank, low, high, ...)`` with the values of the group below, on and between them."""
    most = bounds.agg(F.max("t")).first()[0]
    if most is None:
        return bounds.select("*", *[F.lit(0).cast("bigint").alias(c) for c in ("below", "on_low", "between", "on_high")])
    tests, x = [], F.col("x")
    joined = rows.join(_columns(bounds, most), "g")
    for t in range(most + 1):
        low, high = F.col(f"low{t}"), F.col(f"high{t}")
        tests += [F.count_if(x < low).alias(f"a{t}"), F.count_if(x == low).alias(f"b{t}"), F.count_if((x > low) & (x < high)).alias(f"c{t}"), F.count_if((x == high) & (high > low)).alias(f"d{t}")]
    counts = joined.groupBy("g").agg(*tests)
    tall = counts.select("g", F.inline(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col(f"a{t}").alias("below"), F.col(f"b{t}").alias("on_low"), F.col(f"c{t}").alias("between"), F.col(f"d{t}").alias("on_high"))
        for t in range(most + 1)
    ])))
    return bounds.join(tall, ["g", "t"])


def _columns(bounds: DataFrame, most: int) -> DataFrame:
    """One row per group with its bounds side by side."""
    at = lambda c, t: F.max(F.when(F.col("t") == t, F.col(c))).alias(f"{c}{t}")
    return bounds.groupBy("g").agg(*[at(c, t) for t in range(most + 1) for c in ("low", "high")])


def _any(tests: list[Column]) -> Column:
    found = tests[0]
    for test in tests[1:]:
        found = found | test
    return found


def _between(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """``(g, t, x)`` of the values between the bounds. Other rows end at the filter."""
    most = bounds.agg(F.max("t")).first()[0] or 0
    inside = [(F.col("x") > F.col(f"low{t}")) & (F.col("x") < F.col(f"high{t}")) for t in range(most + 1)]
    near = rows.join(_columns(bounds, most), "g").filter(_any([F.coalesce(test, F.lit(False)) for test in inside]))
    return near.select("g", "x", F.explode(F.array(*[F.when(test, F.lit(t)) for t, test in enumerate(inside)])).alias("t")).filter("t is not null")


def grouped_quantiles(rows: DataFrame, probs: Sequence[float]) -> DataFrame:
    """``(g, n, q0, q1, ...)``: number of values of each group and its quantiles by linear
    interpolation, from ``rows (g, x)`` with x a double. Rows without g or x are left out."""
    rows = rows.select("g", F.col("x").cast("double").alias("x")).filter("g is not null and x is not null")
    groups = _written(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), _grid(F.col("x")).alias("grid")), "groups")
    ranks = [F.struct(F.lit(2 * i + k).alias("t"), edge((F.col("n") - F.lit(1)) * F.lit(p)).cast("bigint").alias("rank")) for i, p in enumerate(probs) for k, edge in enumerate((F.floor, F.ceil))]
    wanted = groups.select("g", "n", "grid", F.inline(F.array(*ranks)))
    outer = {"least": F.element_at("grid", 1), "greatest": F.element_at("grid", -1)}
    bounds = wanted.select("g", "t", "rank", *[e.alias(c) for c, e in outer.items()], _step(F.col("grid"), F.col("rank"), F.col("n"), -MARGIN).alias("low"), _step(F.col("grid"), F.col("rank"), F.col("n"), MARGIN + 1).alias("high"))
    answers = []
    bounds = _written(bounds, "bounds")
    while True:
        at = _written(_counted(rows, bounds), "counts")
        upto_low, upto_mid = F.col("below") + F.col("on_low"), F.col("below") + F.col("on_low") + F.col("between")
        upto_high = upto_mid + F.col("on_high")
        missed = (F.col("rank") < F.col("below")) | (F.col("rank") >= upto_high)
        value = F.when(missed, F.lit(None)).when(F.col("rank") < upto_low, F.col("low")).when(F.col("rank") >= upto_mid, F.col("high"))
        at = at.select("*", missed.alias("missed"), value.cast("double").alias("value"), (F.col("rank") - upto_low).alias("inside"))
        answers.append(at.filter("value is not null").select("g", "t", "value"))
        open_ = at.filter("value is null")
        few = open_.filter(~F.col("missed") & (F.col("between") <= F.lit(COLLECT_LIMIT)))
        many = open_.filter(F.col("missed") | (F.col("between") > F.lit(COLLECT_LIMIT)))
        left = open_.agg(F.count_if(~F.col("missed") & (F.col("between") <= F.lit(COLLECT_LIMIT))).alias("few"), F.count_if(F.col("missed") | (F.col("between") > F.lit(COLLECT_LIMIT))).alias("many")).first()
        if left["few"]:
            upto = Window.partitionBy("g", "t").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
            values = _between(rows, few).groupBy("g", "t", "x").agg(F.count(F.lit(1)).alias("k")).withColumn("upto", F.sum("k").over(upto))
            found = values.join(few.select("g", "t", "inside"), ["g", "t"]).filter((F.col("inside") < F.col("upto")) & (F.col("inside") >= F.col("upto") - F.col("k")))
            answers.append(found.select("g", "t", F.col("x").alias("value")))
        if not left["many"]:
            break
        # Where the bounds missed the rank, the search goes on between them and the outer bound.
        wider = many.filter("missed").select(
            "g", "t", "rank", "least", "greatest", F.when(F.col("rank") < F.col("below"), F.col("least")).otherwise(F.col("high")).alias("low"),
            F.when(F.col("rank") < F.col("below"), F.col("low")).otherwise(F.col("greatest")).alias("high"),
        )
        wide = many.filter("not missed")
        grids = _between(rows, wide).groupBy("g", "t").agg(_grid(F.col("x")).alias("grid"))
        closer = wide.join(grids, ["g", "t"]).select(
            "g", "t", "rank", F.col("low").alias("least"), F.col("high").alias("greatest"),
            _step(F.col("grid"), F.col("inside"), F.col("between"), -MARGIN).alias("low"), _step(F.col("grid"), F.col("inside"), F.col("between"), MARGIN + 1).alias("high"),
        )
        bounds = _written(closer.unionByName(wider), "bounds")
    found = answers[0]
    for more in answers[1:]:
        found = found.unionByName(more)
    values = found.groupBy("g").agg(*[F.max(F.when(F.col("t") == t, F.col("value"))).alias(f"v{t}") for t in range(2 * len(probs))])
    position = [(F.col("n") - F.lit(1)) * F.lit(p) for p in probs]
    line = [
        (F.col(f"v{2 * i}") + (F.col(f"v{2 * i + 1}") - F.col(f"v{2 * i}")) * (at - F.floor(at))).alias(f"q{i}") for i, at in enumerate(position)
    ]
    return groups.select("g", "n", *[e.alias(c) for c, e in outer.items()]).join(values, "g").select("g", "n", "least", "greatest", *line)
