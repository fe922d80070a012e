"""Golden numbers of the sample table, and edge cases of the reports."""

from __future__ import annotations

import csv
import hashlib
import io
import json
from collections import Counter

import numpy as np
import pytest
from sample import STATION_CSV

from tabwright import run_transform
from tabwright.operators import charts, contract as ct, grouped_quantiles, profile as pf, readiness as rd, validate as vd
from tabwright.operators.contract import ExpectedColumn


def by(df, key="column"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def station_profile(stations):
    return pf.profile(stations)


ROWS = list(csv.DictReader(io.StringIO(STATION_CSV)))


def test_sample_types(stations):
    assert dict(stations.dtypes) == {
        "station_id": "string", "keeper": "string", "altitude": "bigint", "soil": "string", "days_active": "bigint", "installed": "string",
        "moisture": "double", "yield_text": "string", "zone": "string", "power": "string", "failed": "string",
    }


def test_sample_table(station_profile):
    t = station_profile["table"].first()
    assert (t.row_count, t.column_count, t.duplicate_row_count, round(t.duplicate_row_percentage, 2)) == (26, 11, 2, 7.69)
    assert (t.total_missing_values, round(t.total_missing_percentage, 2)) == (3, 1.05)


@pytest.mark.parametrize("name", ["altitude", "days_active", "moisture"])
def test_sample_numeric(station_profile, name):
    r = by(station_profile["numeric"])[name]
    values = np.array([float(x[name]) for x in ROWS if x[name]])
    assert r.missing_count == len(ROWS) - len(values)
    got = (r["mean"], r["median"], r["std"], r["min"], r["max"], r.q25, r.q75)
    assert got == pytest.approx((values.mean(), np.median(values), values.std(), values.min(), values.max(), *np.quantile(values, [0.25, 0.75])))
    rows = sorted((b.bin, b["count"]) for b in station_profile["histogram"].collect() if b.column == name)
    assert [n for _, n in rows] == list(np.histogram(values, 10)[0])


def test_sample_issues(stations, station_profile):
    issues = sorted((r.code, r.severity, r.column, r.affected_rows) for r in station_profile["issues"].fillna("", ["column"]).collect())
    assert issues == [
        ("DUPLICATE_ROWS", "warning", "", 2), ("MIXED_DATA_TYPES", "critical", "yield_text", 2), ("OUTLIERS_DETECTED", "warning", "days_active", 1),
    ]
    assert station_profile["score"].first().health_score == 69.6  # 100 - 0.8 * 1.05 - 1.5 * 7.69 - 10 - 2 * 4
    assert by(pf.iqr_outliers(stations))["days_active"].sample_1 == 4000.0
    assert by(pf.mixed_type_check(stations))["yield_text"].dirty_samples == "unknown"
    assert by(station_profile["dates"])["installed"].inferred_type == "string_as_date"


def test_sample_text(station_profile):
    r = by(station_profile["categorical"])
    assert (r["station_id"].unique_count, r["soil"].unique_count, r["zone"].unique_count) == (24, 2, 3)
    top = {(t.column, t.value): t["count"] for t in station_profile["top_values"].collect()}
    for name in ("failed", "soil"):
        assert {v: n for (c, v), n in top.items() if c == name} == Counter(x[name] for x in ROWS)


def test_sample_readiness(stations):
    r = rd.ml_readiness(stations, "classification", "failed").first()
    assert (r.readiness_score, r.overall_status) == (51.3, "needs_attention")
    flagged = {f.column for f in rd.ml_findings(stations, "classification", "failed", ["ID_COLUMN"]).collect()}
    assert flagged == {"station_id", "keeper", "installed", "yield_text"}
    steps = rd.ml_recommendations(stations, "classification", "failed").orderBy("step").collect()
    df = stations
    for s in steps:
        params = json.loads(s.params_json)
        if all(c in df.columns for c in params.get("columns", [])):
            df = run_transform(df, s.operation, params)
    assert "split_assignment" in df.columns and "soil_clay" in df.columns  # loam comes first and is dropped


CONTRACT = [
    ExpectedColumn("station_id", nullable=False), ExpectedColumn("keeper", nullable=False),
    ExpectedColumn("altitude", "integer", nullable=False, min_value=0, max_value=900),
    ExpectedColumn("soil", allowed_values=("clay", "loam", "sand")),
    ExpectedColumn("days_active", "integer", nullable=False, min_value=0, max_value=365),
    ExpectedColumn("installed", "date", nullable=False),
    ExpectedColumn("moisture", "float", nullable=False, min_value=0, max_value=100),
    ExpectedColumn("yield_text", "float", nullable=False, min_value=0),
    ExpectedColumn("failed", nullable=False, allowed_values=("yes", "no")),
]


def test_sample_contract(stations):
    result = ct.check_contract(stations, ct.contract_from_json(ct.contract_to_json(CONTRACT)))
    found = sorted((i[0], i[1], i[2], i[5]) for i in result.issues)
    assert found == [
        ("altitude", "critical", "nullability_violation", 2), ("days_active", "warning", "constraint_violation", 1), ("installed", "warning", "type_mismatch", 26),
        ("yield_text", "critical", "nullability_violation", 1), ("yield_text", "critical", "type_mismatch", 1),
    ]
    assert result.unexpected == ["zone", "power"] and result.compatibility == "incompatible"


def test_contract_rules(spark):
    df = spark.createDataFrame([(1.0, "a1", "A", True, 5), (2.5, "b", "c", None, 7), (None, None, "zz", False, 9)], "f double, s string, e string, b boolean, n int")
    status = {r.column: r.status for r in ct.contract_columns(df, [
        ExpectedColumn("f", "integer"), ExpectedColumn("s", regex_pattern="[a-z]"), ExpectedColumn("b", "string"), ExpectedColumn("n", "float"),
    ]).collect()}
    assert status == {"f": "type_mismatch", "s": "matched", "e": "unexpected", "b": "type_mismatch", "n": "matched"}
    issues = ct.check_contract(df, [ExpectedColumn("f", "integer"), ExpectedColumn("b", "datetime")]).issues
    assert [(i[0], i[2], i[5]) for i in issues] == [("f", "type_mismatch", 2)]
    for more in ((), tuple(f"v{i}" for i in range(5000))):
        issues = ct.check_contract(df, [ExpectedColumn("e", "categorical", allowed_values=("a", "C", *more))]).issues
        assert [(i[2], i[5], i[6]) for i in issues] == [("enum_violation", 1, "zz")]
    with pytest.raises(Exception):
        ct.check_contract(df, [ExpectedColumn("s", regex_pattern="[")])
    assert ct.contract_report(df, [ExpectedColumn("n", "integer"), ExpectedColumn("x", required=False)]).first().compatibility_status == "warnings"


def test_empty_and_null_tables(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "a double, s string")
    r = pf.profile_numeric(df).first()
    assert r["mean"] is None and r["median"] is None and r.is_constant and r.missing_count == 2
    assert {i.code for i in pf.quality_issues(df).collect()} == {"DUPLICATE_ROWS", "HIGH_MISSINGNESS"}
    assert pf.profile_histogram(df).count() == 0 and pf.top_values(df).count() == 0 and pf.iqr_outliers(df).count() == 0
    none = df.limit(0)
    assert vd.validation_report(none).first().overall_status == "failed" and pf.health_score(none).first().health_score == 100.0
    assert vd.validate_constant(df).count() == 2 and {r.severity for r in vd.validate_nulls(df).collect()} == {"critical"}
    assert charts.chart_kde(df, "a").count() == 0 and charts.chart_box(df, "a").count() == 0 and charts.chart_histogram(df, "a").count() == 0
    assert charts.distribution_stats(df, "a").first()["count"] == 0 and charts.pearson(df, "a", "a").first()[0] is None
    assert rd.ml_readiness(none, "regression", "a").first().overall_status in ("ready", "needs_attention", "not_ready")


def test_nested_columns_are_profiled_as_json(spark):
    df = spark.createDataFrame([([1, 2], {"k": 1}), ([1, 2], {"k": 1}), (None, None)], "xs array<int>, m map<string,int>")
    r = by(pf.profile_categorical(df))
    assert r["xs"].unique_count == 1 and r["m"].unique_count == 1
    assert vd.validate_duplicates(df).first().row_count == 1


def test_readiness_targets(spark):
    df = spark.createDataFrame([(float(i), "t" if i % 2 else "u") for i in range(20)], "x double, t string")
    codes = lambda task, target: [f.code for f in rd.ml_findings(df, task, target).collect()]
    assert "NO_TARGET" in codes("classification", None) and "UNKNOWN_TARGET" in codes("regression", "zz")
    assert "NON_NUMERIC_TARGET" in codes("regression", "t") and codes("clustering", None) == ["RAW_TEXT_FEATURES", "NO_SPLIT"]
    split = run_transform(df, "train_test_split")
    assert rd.ml_readiness(split, "classification", "t").first().readiness_score == 100.0
    with pytest.raises(ValueError):
        rd.audit(df, "ranking", "t")


@pytest.fixture(scope="module")
def people(spark):
    rows = [(20, 30.0, "A"), (21, 31.0, "A"), (22, 33.0, "B"), (23, 35.0, "B"), (None, 36.0, "B"), (100, 90.0, "A")]
    return spark.createDataFrame(rows, "age bigint, income double, segment string")


def test_chart_roles(people):
    assert {r.column: (r.role, r.missing_count) for r in charts.chart_metadata(people).collect()} == {"age": ("numeric", 1), "income": ("numeric", 0), "segment": ("categorical", 0)}
    kinds = [r.chart_type for r in charts.chart_recommendations(people).orderBy("rank").collect()]
    assert kinds == ["histogram", "kde", "box", "bar", "scatter", "correlation_heatmap", "grouped_box", "missing_bar", "missing_heatmap"]


def test_charts_by_name(people):
    bins = charts.generate_chart(people, "histogram", ["age"], bins=5).collect()
    assert len(bins) == 5 and sum(b["count"] for b in bins) == 5
    missing = {r.column: r.missing for r in charts.generate_chart(people, "missing_bar").collect()}
    assert missing == {"age": 1, "income": 0, "segment": 0}
    groups = {r.group: (r["count"], r["median"]) for r in charts.generate_chart(people, "grouped_box", ["income", "segment"]).collect()}
    assert groups == {"A": (3, 31.0), "B": (3, 35.0)}
    assert charts.generate_chart(people, "scatter", x_column="age", y_column="income").count() == 5
    assert charts.generate_chart(people, "missing_heatmap").count() == 18
    for method in ("pearson", "spearman"):
        expected = people.toPandas()[["age", "income"]].corr(method=method)
        for r in charts.generate_chart(people, "correlation_heatmap", ["age", "income"], correlation_method=method).collect():
            assert r.value == pytest.approx(expected.loc[r.y, r.x])


@pytest.mark.parametrize("kind, columns", [
    ("histogram", ["segment"]), ("bar", ["age"]), ("pie", ["age"]), ("scatter", ["age"]), ("kde", ["zz"]), ("line", ["segment", "age"]),
    ("grouped_box", ["age", "income"]), ("correlation_heatmap", ["age", "segment"]), ("pair_plot", ["segment", "age"]),
])
def test_chart_rejections(people, kind, columns):
    with pytest.raises(ValueError):
        charts.generate_chart(people, kind, columns)


def test_grouped_box_has_all_groups(spark):
    table = spark.createDataFrame([(float(i), f"g{i % 35:02d}") for i in range(70)], "v double, g string")
    got = charts.chart_grouped_box(table, "v", "g").collect()
    assert [r["group"] for r in got] == [f"g{i:02d}" for i in range(35)]
    assert charts.chart_grouped_box(table, "v", "g", 3).count() == 3


@pytest.mark.parametrize("limit", [3, 20_000])
def test_grouped_quantiles(spark, monkeypatch, limit):
    monkeypatch.setattr(grouped_quantiles, "COLLECT_LIMIT", limit)
    rng = np.random.default_rng(5)
    groups = {
        "hot": np.concatenate([np.full(900, 4.0), rng.normal(4, 2, 1800)]), "wide": np.exp(rng.normal(0, 9, 1500)), "few": rng.integers(0, 3, 700).astype(float),
        "one": np.array([2.5]), "two": np.array([1.0, 2.0]), "same": np.full(50, -1.0),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [(None, 1.0), ("none", None)]
    table = spark.createDataFrame(rows, "g string, x double").repartition(4)
    got = {r["g"]: r for r in grouped_quantiles.grouped_quantiles(table, [0.25, 0.5, 0.9]).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert (got[g]["n"], got[g]["least"], got[g]["greatest"]) == (len(values), values.min(), values.max())
        assert [got[g][f"q{i}"] for i in range(3)] == pytest.approx(np.quantile(values, [0.25, 0.5, 0.9]).tolist())


def test_line_holds_all_points(spark):
    rows = [(i % 977, float(i * 7 % 101)) for i in range(5000)] + [(None, 1.0), (3, None), (4, float("nan"))]
    table = spark.createDataFrame(rows, "x int, y double")
    got = charts.chart_line(table, "x", "y", 50).collect()
    assert sum(r["count"] for r in got) == 5000 and len(got) == 50
    first = min(got, key=lambda r: r.bin)
    points = sorted(r for r in rows[:5000] if r[0] <= first.x_last)
    assert (first.x_first, first.y_first, first.y_last) == (points[0][0], points[0][1], points[-1][1])
    assert [r["count"] for r in charts.chart_line(table.filter("x = 5"), "x", "y").collect()] == [sum(r[0] == 5 for r in rows)]
    assert charts.chart_line(table.limit(0), "x", "y").count() == 0


def test_top_values_of_long_texts(spark):
    head = "same start of a long text " * 4
    texts = [head + "b"] * 3 + [head + "a"] * 3 + [head + "c"] * 3 + [head[:64]] * 3 + ["short"] * 5 + [head + "z"] + [None] * 4 + [""] * 3
    table = spark.createDataFrame([(t, "u") for t in texts], "t string, head string")
    got = [(r["value"], r["count"]) for r in pf.top_values(table, 4, ["t"]).orderBy("rank").collect()]
    assert got == [("short", 5), (head + "c", 3), (head + "b", 3), (head + "a", 3)]
    assert [r["value"] for r in pf.top_values(table, 7, ["t"]).orderBy("rank").collect()][4:] == [head[:64], "", head + "z"]
    assert pf.top_values(table, 3).filter("column = 'head'").count() == 1 and pf.top_values(table.limit(0)).count() == 0


def test_samples_by_threshold(spark):
    table = spark.range(3000).selectExpr("id", "CAST(id % 2 AS DOUBLE) AS v", "IF(id % 3 = 0, 7, id) AS k")
    for n in (100, 2999, 5000):
        got = {r["id"] for r in charts.sample_rows(table, n, "id").collect()}
        want = sorted(range(3000), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())[:n]
        assert got == set(want)
    assert charts.sample_rows(table, 500, "k").count() == 500  # a third of the rows share a key
    assert charts.generate_chart(table, "missing_heatmap", sample_size=150).count() == 450


def test_pearson_of_many_columns(spark, monkeypatch):
    """All pairs are added up together; only pairs far from the means are measured on their own."""
    rng = np.random.default_rng(8)
    shared = rng.normal(size=400)
    columns = {f"c{i}": np.where(rng.random(400) < 0.1, np.nan, 10.0 ** (i % 9) * (3 + shared + rng.normal(size=400))) for i in range(30)}
    columns["whole"] = rng.integers(0, 9, 400).astype(float)
    columns["stuck"] = np.where(np.isnan(columns["c0"]), rng.normal(size=400), 0.1)  # constant beside c0
    columns["apart"] = np.where(np.isnan(columns["c1"]), -1e9, rng.normal(size=400))  # far from its mean beside c1
    columns["constant"], columns["missing"] = np.full(400, 0.1), np.full(400, np.nan)
    names = list(columns)
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(*columns.values())]
    table = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(3)
    single, alone = charts._around_means, []
    monkeypatch.setattr(charts, "_around_means", lambda df, pairs: alone.extend(pairs) or single(df, pairs))
    got = {(r.x, r.y): r.value for r in charts.chart_corr_pearson(table, names).collect()}
    for x in names:
        for y in names:
            both = ~np.isnan(columns[x]) & ~np.isnan(columns[y])
            a, b = columns[x][both], columns[y][both]
            if not both.any() or np.ptp(a) == 0 or np.ptp(b) == 0:
                assert got[x, y] is None
            else:
                assert got[x, y] == pytest.approx(np.corrcoef(a, b)[0, 1], rel=1e-9, abs=1e-12)
    hard = {tuple(names[i] for i in pair) for pair in alone}
    assert {("c0", "stuck"), ("c1", "apart")} <= hard and all({"stuck", "apart"} & set(pair) for pair in hard)
    assert {r.value for r in charts.chart_corr_pearson(table.limit(0), names).collect()} == {None}
