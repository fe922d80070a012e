"""Behaviour of the transforms on small frames."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tabwright import run_transform
from tabwright.operators import encode
from tabwright.operators.cast import CastType, cast_report
from tabwright.operators.dedup import duplicate_count, head_sample, page_rows
from tabwright.operators.dispatch import fit_transform, make_transform
from tabwright.operators.filters import search_rows
from tabwright.operators.preview import preview


def column(df, name):
    return [r[name] for r in df.collect()]


def one(spark, kind, values, name="value"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} {kind}").coalesce(1)


@pytest.mark.parametrize("values, target, expected", [
    (["1.5", "bad", None, "3"], "float", [1.5, None, None, 3.0]),
    (["$75,000", "salary 95000", "USD 120000", "N/A", "-", None], "integer", [75000, 95000, 120000, None, None, None]),
    (["abc123", "salary 95000"], "integer", [None, 95000]),
    (["1.5", "12 yrs", "€7", "£8%", " 9 ", "+4", "5."], "integer", [None, 12, 7, 8, 9, 4, None]),
    (["1e3", ".5", "5.", "12d", "nan", "Infinity", "1 2"], "float", [1000.0, 0.5, 5.0, None, None, None, None]),
    (["true", "false", "yes", "0", "unknown", None], "boolean", [True, False, True, False, None, None]),
    ([" T ", "Y", "n", "F", "1", "2"], "boolean", [True, True, False, False, True, None]),
])
def test_cast_text(spark, values, target, expected):
    assert column(run_transform(one(spark, "string", values), "cast_type", {"column": "value", "target_type": target}), "value") == expected


def test_cast_numbers(spark):
    df = one(spark, "double", [0.0, 1.0, 2.0, 1.9, None, float("nan")])
    assert column(run_transform(df, "cast_type", {"column": "value", "target_type": "boolean"}), "value") == [False, True, None, None, None, None]
    assert column(run_transform(df, "cast_type", {"column": "value", "target_type": "integer"}), "value") == [0, 1, 2, 1, None, None]


def test_cast_dates_and_category(spark):
    df = spark.createDataFrame([("2025-01-01", "a"), ("invalid", "b")], "when string, label string")
    dates = run_transform(df, "cast_type", {"column": "when", "target_type": "date", "format": "%Y-%m-%d"})
    assert column(dates, "when") == [dt.date(2025, 1, 1), None]
    assert column(run_transform(df, "cast_type", {"column": "when", "target_type": "date"}), "when") == [dt.date(2025, 1, 1), None]
    stamps = run_transform(df, "cast_type", {"column": "when", "target_type": "datetime"})
    assert dict(stamps.dtypes)["when"] == "timestamp_ntz" and column(stamps, "when") == [dt.datetime(2025, 1, 1), None]
    labels = run_transform(df, "cast_type", {"column": "label", "target_type": "category"})
    assert labels.schema["label"].metadata == {"logical_type": "categorical"}
    with pytest.raises(ValueError, match="Unsupported target type"):
        run_transform(df, "cast_type", {"column": "label", "target_type": "money"})


def test_cast_default_fills_original_nulls(spark):
    df = one(spark, "string", ["true", "unknown", None])
    params = {"column": "value", "target_type": "boolean", "invalid_strategy": "replace_default", "default_value": "false"}
    assert column(run_transform(df, "cast_type", params), "value") == [True, False, False]
    report = cast_report(df, CastType(**params)).first()
    assert (report.invalid_count, report.valid_count, report.new_null_count) == (1, 1, 0)


def test_cast_raise(spark):
    with pytest.raises(ValueError, match="1 values"):
        run_transform(one(spark, "string", ["1", "bad"]), "cast_type", {"column": "value", "target_type": "integer", "invalid_strategy": "raise"})


def test_fill(spark):
    df = one(spark, "double", [1.0, float("nan"), None, 3.0])
    assert column(run_transform(df, "fill_missing_mean", {"columns": ["value"]}), "value") == [1.0, 2.0, 2.0, 3.0]
    ints = one(spark, "int", [1, 2, None])
    assert column(run_transform(ints, "fill_missing", {"columns": "value", "strategy": "median"}), "value") == [1.0, 2.0, 1.5]
    ties = one(spark, "string", ["b", "a", None, "b", "a"])
    out, fitted = fit_transform(ties, "fill_missing_mode", {"columns": ["value"]})
    assert column(out, "value")[2] == "a" and fitted == {"filled_values": {"value": "a"}}
    empty, fitted = fit_transform(one(spark, "double", [None, None]), "fill_missing_mean", {"columns": ["value"]})
    assert column(empty, "value") == [None, None] and fitted == {"filled_values": {}}
    flags = spark.createDataFrame([(True,), (None,), (False,)], "active boolean")
    with pytest.raises(ValueError, match="not_a_boolean"):
        run_transform(flags, "fill_missing_constant", {"columns": ["active"], "value": "not_a_boolean"})
    assert column(run_transform(flags, "fill_missing_constant", {"columns": ["active"], "value": "yes"}), "active") == [True, True, False]
    with pytest.raises(ValueError):
        run_transform(ints, "fill_missing_constant", {"columns": ["value"], "value": "many"})
    with pytest.raises(ValueError, match="non-numeric"):
        run_transform(ties, "fill_missing_mean", {"columns": ["value"]})


def test_option_checks(spark):
    df = one(spark, "double", [1.0, 2.0, 100.0])
    for operation, params in [
        ("change_case", {"columns": ["value"], "case": "camel"}),
        ("handle_outliers", {"columns": ["value"], "method": "mad"}),
        ("handle_outliers", {"columns": ["value"], "action": "mark"}),
        ("remove_duplicates", {"subset": ["i"], "keep": "any"}),
        ("filter_rows", {"column": "value", "operator": "~"}),
        ("filter_rows", {"column": "value", "operator": ">", "value": "many"}),
        ("drop_column", {"columns": ["i", "value"]}),
        ("duplicate_column", {"source_column": "i", "new_column": "value"}),
        ("rename_column", {"mapping": {"I": "j"}}),
        ("select_columns", {"columns": ["Value"]}),
        ("nonsense", {}),
        ("sort_rows", {"rows": 3}),
    ]:
        with pytest.raises(ValueError):
            run_transform(df, operation, params)
    assert make_transform(" Drop Missing ") == make_transform("drop-missing")


def test_filters_ignore_non_finite(spark):
    df = one(spark, "double", [1.0, float("nan"), float("inf"), -float("inf"), None, 5.0])
    keep = lambda operator, value=None: column(run_transform(df, "filter_rows", {"column": "value", "operator": operator, "value": value}), "i")
    assert keep(">", 0) == [0, 5] and keep("!=", 1) == [5] and keep("<", 10) == [0, 5]
    assert keep("is_not_null") == [0, 5] and keep("is_null") == [1, 2, 3, 4]
    flags = spark.createDataFrame([(True,), (None,), (False,)], "value boolean")
    assert run_transform(flags, "filter_rows", {"column": "value", "value": "True"}).count() == 1
    days = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 5, 1),)], "value date")
    assert run_transform(days, "filter_rows", {"column": "value", "operator": ">", "value": "2024-02-01"}).count() == 1


def test_filter_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    out = run_transform(df, "filter_rows", {"column": "l_quantity", "operator": ">", "value": 30}).select("l_orderkey")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,30.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_search(spark):
    df = spark.createDataFrame([("Alpha", 10), (None, 21), ("beta", 3)], "name string, n int")
    assert column(search_rows(df, "A"), "n") == [10, 3] and column(search_rows(df, "1"), "n") == [10, 21]


def test_text(spark):
    df = one(spark, "string", ["  a \t b\n", "O'neil mary", None, "x.y.z", " wide "])
    get = lambda operation, **p: column(run_transform(df, operation, {"columns": ["value"], **p}), "value")
    assert get("trim_whitespace") == ["a \t b", "O'neil mary", None, "x.y.z", "wide"]
    assert get("normalize_strings")[0] == "a b"
    assert get("change_case", case="Title")[1] == "O'neil Mary"
    assert get("replace_text", pattern=".", replacement="$1\\")[3] == "x$1\\y$1\\z"
    assert get("replace_text", pattern=r"(\w)\.", replacement="<$1>", is_regex=True)[3] == "<x><y>z"


def test_dates(spark):
    df = spark.createDataFrame([("2024-02-29",), ("05/03/2024",), ("2024-13-01",), (None,)], "day string")
    out = run_transform(df, "parse_dates", {"columns": ["day"], "format": "%Y-%m-%d", "extract_components": ["year", "month", "day", "day_of_week"]})
    assert out.columns == ["day", "day_year", "day_month", "day_day", "day_weekday"]
    assert tuple(out.first()) == (dt.date(2024, 2, 29), 2024, 2, 29, 4) and column(out, "day")[1:] == [None, None, None]
    days = spark.createDataFrame([("25/12/2023",), ("01/02/2024",), ("31/01/2024",)], "day string")
    assert column(run_transform(days, "parse_dates", {"columns": "day"}), "day") == [dt.date(2023, 12, 25), dt.date(2024, 2, 1), dt.date(2024, 1, 31)]
    assert column(run_transform(spark.createDataFrame([("3 Mar 2024",), ("03 Mar 2024",)], "day string"), "parse_dates", {"columns": "day", "format": "%d %b %Y"}), "day")[1] == dt.date(2024, 3, 3)
    with pytest.raises(ValueError):
        run_transform(days, "parse_dates", {"columns": "day", "format": "%Q"})


def test_scale(spark):
    df = spark.createDataFrame([(1.0, 5, None), (2.0, 5, None), (3.0, 5, None), (None, None, None)], "a double, b int, c double").coalesce(1)
    out, fitted = fit_transform(df, "standard_scale", {"columns": ["a", "b", "c"]})
    assert column(out, "a") == [-1.0, 0.0, 1.0, None] and column(out, "b") == [0.0, 0.0, 0.0, None] and column(out, "c") == [None] * 4
    assert fitted["learned_stats"]["c"]["mean"] is None
    out = run_transform(df, "min_max_scale", {"columns": ["a", "b", "c"], "min_target": 2, "max_target": 4})
    assert column(out, "a") == [2.0, 3.0, 4.0, None] and column(out, "b") == [2.0, 2.0, 2.0, None] and column(out, "c") == [None] * 4
    logs = column(run_transform(one(spark, "double", [0.0, -1.0, math.e - 1, None]), "log_transform", {"columns": "value"}), "value")
    assert logs[:2] == [0.0, None] and logs[2] == pytest.approx(1.0) and logs[3] is None


def test_outliers(spark):
    df = one(spark, "int", [1, 2, 3, 4, 100, None])
    clipped = column(run_transform(df, "handle_outliers", {"columns": ["value"]}), "value")
    assert clipped == [1.0, 2.0, 3.0, 4.0, 7.0, None]
    assert column(run_transform(df, "handle_outliers", {"columns": ["value"], "action": "remove"}), "i") == [0, 1, 2, 3, 5]
    assert column(run_transform(one(spark, "double", [None, None]), "handle_outliers", {"columns": ["value"]}), "value") == [None, None]


def test_sequential_removal(spark):
    rows = [(float(i), float(i)) for i in range(20)] + [(1000.0, 15.0), (10.0, 900.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    out = run_transform(df, "handle_outliers", {"columns": ["a", "b"], "method": "zscore", "action": "remove"})
    assert sorted(r.a for r in out.collect()) == [float(i) for i in range(20)]


def test_encode(spark):
    df = one(spark, "string", ["A", None, "B", "A"], "category")
    out = run_transform(df, "one_hot_encode", {"columns": ["category"]})
    assert out.columns == ["i", "category_A", "category_B"]
    assert column(out, "category_A") == [1, 0, 0, 1] and column(out, "category_B") == [0, 0, 1, 0]
    odd = one(spark, "string", ["a-b", "a_b", "!!", "a b"], "c")
    assert run_transform(odd, "one_hot_encode", {"columns": ["c"], "order_by": ["i"]}).columns == ["i", "c_a_b", "c_a_b_1", "c_value", "c_a_b_2"]
    assert run_transform(odd, "one_hot_encode", {"columns": ["c"], "order_by": ["i"], "max_categories": 2, "drop_first": True}).columns == ["i", "c_a_b"]
    ranks = run_transform(odd, "ordinal_encode", {"column": "c", "order": ["!!", "a b", "!!"]})
    assert column(ranks, "c") == [None, None, 0, 1]


def test_dedup(spark):
    rows = [(1, "x", 3), (1, "y", 1), (2, "x", 2), (1, "x", 3), (None, "z", 5), (None, "w", 4)]
    df = spark.createDataFrame(rows, "k int, v string, n int").repartition(3)
    assert run_transform(df, "drop_duplicates").count() == 5
    first = run_transform(df, "remove_duplicates", {"subset": ["k"], "order_by": ["n"]})
    assert first.columns == ["k", "v", "n"] and sorted(map(tuple, first.collect()), key=repr) == [(1, "y", 1), (2, "x", 2), (None, "w", 4)]
    last = run_transform(df, "remove_duplicates", {"subset": "k", "keep": "last", "order_by": ["n"]})
    assert sorted(map(tuple, last.collect()), key=repr) == [(1, "x", 3), (2, "x", 2), (None, "z", 5)]
    assert tuple(duplicate_count(df).first()) == (6, 1) and tuple(duplicate_count(df.limit(0)).first()) == (0, 0)


def test_sort_and_page(spark):
    df = one(spark, "double", [3.0, None, 1.0, 2.0]).repartition(3)
    assert column(run_transform(df, "sort_rows", {"columns": "value"}), "value") == [None, 1.0, 2.0, 3.0]
    assert column(run_transform(df, "sort_rows", {"columns": ["value"], "descending": True}), "value") == [None, 3.0, 2.0, 1.0]
    assert column(page_rows(df, 2, 2, ["value"]), "value") == [2.0, 3.0] and page_rows(df, 3, 2).count() == 0
    assert column(head_sample(df, ["i"], 2), "i") == [0, 1]
    for page, size in ((0, 10), (1, 501), (1, 0)):
        with pytest.raises(ValueError):
            page_rows(df, page, size)


def test_duplicates_with_maps(spark):
    df = spark.sql("SELECT * FROM VALUES (1, map('a', 1, 'b', 2), 5), (1, map('b', 2, 'a', 1), 5), (2, map('a', 1), 6), (2, map('a', 3), 4) AS t(k, m, v)")
    assert duplicate_count(df).first().duplicate_count == 1
    assert run_transform(df, "remove_duplicates", {}).count() == 3
    kept = run_transform(df, "remove_duplicates", {"subset": ["k"], "keep": "last", "order_by": ["v"]})
    assert sorted((r.k, r.m, r.v) for r in kept.collect()) == [(1, {"a": 1, "b": 2}, 5), (2, {"a": 1}, 6)]
    assert run_transform(df, "remove_duplicates", {"subset": ["m"]}).count() == 3


def test_sort_spreads_a_hot_key(spark):
    df = spark.range(0, 60_000, 1, 6).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), F.lit("x").alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = run_transform(df, "sort_rows", {"columns": ["k"]})
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 60_000 and max(sizes) < 20_000


def test_preview(spark):
    df = one(spark, "string", ["1", "bad", None])
    report = preview(df, "cast_type", {"column": "value", "target_type": "integer"})
    assert report.report.first().validation_passed and [tuple(r) for r in report.warnings.collect()] == [("CAST_TO_NULL", 1)]
    empty = preview(df, "filter_rows", {"column": "value", "value": "zzz"})
    assert not empty.report.first().validation_passed and empty.warnings.first().code == "EMPTY_RESULT"
    failed = preview(df, "drop_column", {"columns": ["zzz"]})
    row = failed.report.first()
    assert not row.validation_passed and "zzz" in row.validation_message and row.rows_before == row.rows_after
    gone = preview(df, "drop_column", {"columns": ["i"]})
    assert gone.report.first().columns_removed == "i" and gone.warnings.first().code == "COLUMNS_REMOVED"


def test_results_do_not_depend_on_partitioning(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    for operation, params in [
        ("train_test_split", {"order_by": ["o_orderkey"]}),
        ("remove_duplicates", {"subset": ["o_custkey"], "order_by": ["o_orderdate"]}),
        ("one_hot_encode", {"columns": ["o_orderstatus"], "order_by": ["o_orderkey"]}),
        ("handle_outliers", {"columns": ["o_totalprice"], "action": "remove"}),
    ]:
        results = [sorted(map(tuple, run_transform(df.repartition(n, "o_custkey"), operation, params).collect())) for n in (1, 7)]
        assert results[0] == results[1] and results[0]


def test_one_hot_bounds(spark, monkeypatch):
    rows = [("a", 1), ("b", 2), ("b", 3), ("c", 4), ("c", 5), ("d", 6), (None, 7), ("other", 8)]
    df = spark.createDataFrame(rows, "t string, n int")
    step = encode.OneHotEncode(["t"], max_categories=2, pick="frequent", other=True)
    fitted = step.fit(df)
    assert [m[1] for m in fitted["category_mapping"]] == ["b", "c"] and fitted["other_mapping"][0][2:] == ["t_other", 3]
    got = {r["n"]: (r["t_b"], r["t_c"], r["t_other"]) for r in step.apply(df, fitted).collect()}
    assert got[2] == (1, 0, 0) and got[6] == (0, 0, 1) and got[7] == (0, 0, 0)
    assert [m[1] for m in encode.OneHotEncode(["t"], max_categories=3, order_by=["n"]).fit(df)["category_mapping"]] == ["a", "b", "c"]
    monkeypatch.setattr(encode, "MAX_CATEGORIES", 3)
    with pytest.raises(ValueError, match="more than 3 categories"):
        run_transform(df, "one_hot_encode", {"columns": ["t"]})
    with pytest.raises(ValueError, match="pick"):
        run_transform(df, "one_hot_encode", {"columns": ["t"], "pick": "best"})
