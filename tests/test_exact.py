"""Exact selection, paging and splitting against brute force, with small limits so that all
rounds run."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright import run_transform
from tabwright.operators import quantiles, ranks, split
from tabwright.operators.charts import spearman
from tabwright.operators.dedup import page_rows

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def numbers(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}").repartition(4)


def cases():
    rng = np.random.default_rng(7)
    hot = np.concatenate([np.full(3000, 5.0), rng.normal(5, 1, 3000), np.full(1500, 9.0)])
    return {
        "uniform": rng.uniform(-1e6, 1e6, 5000), "hot": hot, "few": rng.integers(0, 4, 4000).astype(float),
        "wide": np.exp(rng.normal(0, 20, 4000)), "one": np.array([3.25]), "two": np.array([1.0, 2.0]),
    }


@pytest.mark.parametrize("name", list(cases()))
@pytest.mark.parametrize("limit", [10, 50_000])
def test_quantiles(spark, monkeypatch, name, limit):
    monkeypatch.setattr(quantiles, "COLLECT_LIMIT", limit)
    values = cases()[name]
    got = quantiles.exact_quantiles(numbers(spark, values.tolist()), ["x"], PROBS)["x"]
    assert got == pytest.approx(np.percentile(values, [100 * p for p in PROBS]).tolist(), rel=1e-12)


def test_quantiles_skip_missing_and_handle_long_integers(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "COLLECT_LIMIT", 3)
    got = quantiles.exact_quantiles(numbers(spark, [1.0, None, float("nan"), float("inf"), 3.0]), ["x"], [0.5])
    assert got == {"x": [2.0]}
    big = [2**60 + i for i in range(200)]
    _, at = quantiles.values_at_ranks(numbers(spark, big, "bigint"), {"x": F.col("x")}, lambda n: [0, 77, n - 1])["x"]
    assert {r: f.value for r, f in at.items()} == {0: big[0], 77: big[77], 199: big[199]} and at[77].below == 77 and at[77].equal == 1
    rng = np.random.default_rng(1)
    for values in ([2**62 + 1] * 50 + [2**62 + 3] * 50 + [5], [-(2**62) + int(i) for i in rng.integers(0, 30, 200)], [2**61 - 1] * 60):
        _, at = quantiles.values_at_ranks(numbers(spark, values, "bigint"), {"x": F.col("x")}, lambda n: range(0, n, 7))["x"]
        assert {r: tuple(f) for r, f in at.items()} == {r: (v := sorted(values)[r], sum(x < v for x in values), values.count(v)) for r in at}
    tiny = [Decimal(f"1234567890123456789.0000000{i % 10}") for i in range(80)]
    _, at = quantiles.values_at_ranks(numbers(spark, tiny, "decimal(38,8)"), {"x": F.col("x")}, lambda n: [0, 33, 79])["x"]
    assert {r: f.value for r, f in at.items()} == {r: sorted(tiny)[r] for r in at}
    assert quantiles.exact_quantiles(numbers(spark, [None, None]), ["x"], [0.5]) == {"x": [None]}


def test_quantiles_of_many_columns(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "COLLECT_LIMIT", 50)
    df = spark.range(0, 3000).select(*[((F.col("id") * (17 + i)) % 1009).cast("int" if i % 2 else "decimal(12,2)").alias(f"c{i}") for i in range(11)])
    pdf = df.toPandas().astype(float)
    got = quantiles.exact_quantiles(df, df.columns, [0.25, 0.5])
    for c in df.columns:
        assert got[c] == pytest.approx(np.percentile(pdf[c], [25, 50]).tolist())


@pytest.mark.parametrize("rows", [
    [(["b", "a", None, "ab", "abcdefgh", "abcdefghij"][i % 6], i % 7 if i % 5 else None, float(i % 3)) for i in range(400)],
    [("same", 1, 1.0)] * 300 + [("tail", i, 0.5) for i in range(40)],
])
@pytest.mark.parametrize("keys", [["s"], ["n", "s"], ["f", "n"]])
def test_deep_pages(spark, monkeypatch, rows, keys):
    df = spark.createDataFrame(rows, "s string, n int, f double").repartition(3)
    monkeypatch.setattr(quantiles, "COLLECT_LIMIT", 5)
    order = keys + [c for c in df.columns if c not in keys]
    ordered = [tuple(r) for r in df.orderBy(*[F.asc_nulls_first(c) for c in order]).collect()]
    monkeypatch.setattr(ranks, "TIES", 25)
    monkeypatch.setattr(ranks, "TOP_ROWS", 0)
    for page in (1, 9, 50):
        assert [tuple(r) for r in page_rows(df, page, 40, keys).collect()] == ordered[(page - 1) * 40 : page * 40]


def test_deep_pages_by_nested_keys(spark, monkeypatch):
    made = [(i, [float(i % 3), None, float(i % 5)][: i % 4] if i % 9 else None, (i % 4 if i % 6 else None, f"name {i % 7}"), bytes([i % 3, 0, i % 2])) for i in range(200)]
    df = spark.createDataFrame(made, "id int, a array<double>, s struct<n: int, t: string>, b binary").repartition(3)
    monkeypatch.setattr(ranks, "TIES", 3)
    monkeypatch.setattr(ranks, "TOP_ROWS", 0)
    for key in ("a", "s", "b"):
        ordered = [r["id"] for r in df.orderBy(F.asc_nulls_first(key), "id").collect()]
        for page in (4,):
            assert [r["id"] for r in page_rows(df, page, 20, [key, "id"]).collect()] == ordered[(page - 1) * 20 : page * 20]
    with pytest.raises(ValueError, match="cannot be ranked"):
        page_rows(df.select(F.expr("make_dt_interval(0, id)").alias("gap")), 2, 20).collect()


def split_counts(df, **params):
    out = run_transform(df, "train_test_split", params)
    return out, {r["split_assignment"]: r["count"] for r in out.groupBy("split_assignment").count().collect()}


def test_split_sizes(spark, monkeypatch):
    df = spark.range(0, 1003).withColumnRenamed("id", "value")
    for limit in (10, 50_000):
        monkeypatch.setattr(quantiles, "COLLECT_LIMIT", limit)
        out, sizes = split_counts(df, test_size=0.2, validation_size=0.1)
        assert sizes == {"test": 201, "val": 100, "train": 702} and out.select("value").distinct().count() == 1003
    assert split_counts(df, test_size=0.0)[1] == {"train": 1003}
    for params in ({"test_size": 0.6, "validation_size": 0.5}, {"test_size": -0.1}, {"test_size": 1.0}):
        with pytest.raises(ValueError):
            run_transform(df, "train_test_split", params)
    with pytest.raises(ValueError, match="too small"):
        run_transform(df.limit(4), "train_test_split")


def test_split_through_copies(spark, monkeypatch):
    """A third of the rows are copies of one row, another third share the key."""
    monkeypatch.setattr(split, "COPIES_PER_TASK", 17)
    rows = [("hot", 0)] * 100 + [("key", i) for i in range(100)] + [(f"k{i}", i) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, n int").repartition(5)
    for test in (0.1, 0.31, 0.5, 0.77):
        for val in (0.0, 0.2):
            for order_by in (None, ["k"]):
                out, sizes = split_counts(df, test_size=test, validation_size=val, order_by=order_by)
                assert sizes.get("test", 0) == round(300 * test) and sizes.get("val", 0) == round(300 * val)
                assert sorted(map(tuple, out.select("k", "n").collect())) == sorted(rows)
    constant = spark.createDataFrame([("x",)] * 50, "k string")
    assert split_counts(constant, test_size=0.3, validation_size=0.3)[1] == {"train": 20, "val": 15, "test": 15}


@pytest.mark.parametrize("ranges", [2_000_000, 40])
def test_spearman(spark, monkeypatch, ranges):
    from tabwright.operators import charts

    monkeypatch.setattr(charts, "HOT_SHARE", 0.001 if ranges > 40 else 0.1)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 2, 600), 1)
    y = np.where(rng.random(600) < 0.4, 1.0, np.round(x + rng.normal(0, 1, 600), 1))
    rows = [(float(a) if i % 9 else None, float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x double, y double").repartition(3)
    expected = df.toPandas().corr(method="spearman").loc["x", "y"]
    assert spearman(df, [("x", "y")], ranges)[("x", "y")] == pytest.approx(expected, rel=1e-9)
    assert spearman(df.withColumn("y", F.lit(1.0)), [("x", "y")]) == {("x", "y"): None}


@pytest.mark.parametrize("task_rows, files", [(2_000_000, 1), (1500, 4)])
def test_small_rank_ranges_share_tasks(spark, monkeypatch, task_rows, files):
    """The number of tasks and files does not grow with the number of ranges."""
    from tabwright.operators import charts

    monkeypatch.setattr(charts, "TASK_ROWS", task_rows)
    counts = spark.range(3000).selectExpr("CAST(id % 2 AS INT) AS p", "0 AS side", "CAST(id * 7919 % 3000 AS DOUBLE) AS value", "id % 3 + 1 AS n")
    stored = charts._ranged_counts(counts, 6000, 10)
    assert len(stored.inputFiles()) <= files
    rows = sorted(map(tuple, stored.select("p", "value", "n", "range", "passed").collect()))
    assert len(rows) == 3000 and 300 <= len({(r[0], r[3]) for r in rows}) <= 300 + 2 * files
    for p in (0, 1):
        passed = before = 0
        for (_, value, n, at, start), (_, _, _, last, _) in zip([r for r in rows if r[0] == p], [(None, None, None, None, None), *[r for r in rows if r[0] == p]]):
            before = passed if at != last else before
            assert start == before
            passed += n


def test_scans_of_the_measuring_pass(spark):
    """Numbers are read three times, whatever their number; outliers are counted along."""
    from tabwright.operators import facts, profile

    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def passes(_):
        seen.add(1)
        return True

    n = 60_000
    df = spark.range(n, numPartitions=4).select(
        F.col("id").alias("a"), (F.hash("id") % 1000).cast("double").alias("b"), (F.col("id") % 3).alias("c"), F.lit(7).alias("d"),
        F.when(F.col("id") % 1000 == 0, F.col("id") * 50).otherwise(F.hash("id") % 77).alias("e"),
    ).filter(passes("a"))
    table = facts.measure(df, sketch=True)
    quarts, outliers = facts.quartiles_and_outliers(df, table, df.columns)
    assert seen.value <= 3 * n
    rows = np.array([tuple(r) for r in df.collect()], float)
    for i, c in enumerate(df.columns):
        want = np.quantile(rows[:, i], [0.25, 0.5, 0.75])
        assert quarts[c] == want.tolist()
        low, high = want[0] - 1.5 * (want[2] - want[0]), want[2] + 1.5 * (want[2] - want[0])
        assert outliers[c] == ((rows[:, i] < low) | (rows[:, i] > high)).sum()
    seen.value = 0
    profile.profile_numeric(df).collect()
    assert seen.value <= 3 * n


@pytest.mark.parametrize("limit", [50, 20_000])
def test_a_value_that_a_third_of_the_rows_hold(spark, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "COLLECT_LIMIT", limit)
    rng = np.random.default_rng(1)
    for values in (np.concatenate([np.zeros(4000), rng.normal(size=8000)]), np.concatenate([np.full(6001, 5.0), rng.integers(0, 9, 6000)]), rng.exponential(size=9000) ** 3):
        df = numbers(spark, values.tolist())
        got = quantiles.exact_quantiles(df, ["x"], [0.0, 0.25, 1 / 3, 0.5, 0.75, 1.0])["x"]
        assert got == pytest.approx(np.quantile(values, [0.0, 0.25, 1 / 3, 0.5, 0.75, 1.0]))
