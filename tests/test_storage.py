"""Files, versions and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabwright.operators.cast import CastType
from tabwright.operators.dispatch import make_transform, run_transform
from tabwright.operators.impute import FillStatistic
from tabwright.session import scratch_dir
from tabwright.sources import readers, writers
from tabwright.sources.versions import VersionedTable, fingerprint
from tabwright.operators.dedup import duplicate_count
from tabwright.operators.profile import profile_numeric
from tabwright.streaming.stream import accumulate_stream, apply_to_stream, profile_stream, stream_duplicates, stream_quantiles, stream_totals


def write(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv(spark, tmp_path):
    text = 'id,x,flag,day,zip,note\n1,1.5,true,2024-01-01,007,NA\n2,,FALSE,N/A,010,"a, ""b"""\n3,2,,2024-01-03,,None\n'
    df = readers.read_table(spark, write(tmp_path, "t.csv", text))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "bigint", "string"]
    rows = df.orderBy("id").collect()
    assert tuple(rows[0])[:4] == (1, 1.5, True, "2024-01-01") and rows[0].note is None
    assert rows[1].x is None and rows[1].note == 'a, "b"' and rows[2].flag is None and rows[2].note is None
    assert readers.read_table(spark, write(tmp_path, "t.txt", text)).count() == 3


def test_csv_problems(spark, tmp_path):
    ragged = write(tmp_path, "ragged.csv", "a,b\n1,2\n3\n4,5,6\n")
    with pytest.raises(Exception):
        readers.read_csv(spark, ragged).collect()
    rows = readers.read_csv_permissive(spark, ragged, "a bigint, b bigint").collect()
    assert [tuple(r) for r in rows] == [(1, 2), (3, None), (4, 5)]
    bad = write(tmp_path, "bad.csv", "a,b\n1,x\ny,2.5\n")
    assert [tuple(r) for r in readers.read_csv_permissive(spark, bad, "a bigint, b double").collect()] == [(1, None), (None, 2.5)]
    assert [tuple(r) for r in readers.read_csv(spark, write(tmp_path, "ok.csv", "a,b\n1,x\nNA,2.5\n"), schema="a bigint, b string").collect()] == [(1, "x"), (None, "2.5")]
    with pytest.raises(Exception):
        readers.read_csv(spark, bad, schema="a bigint, b double").collect()
    with pytest.raises(ValueError, match="0 rows"):
        readers.read_table(spark, write(tmp_path, "header.csv", "a,b\n"))
    with pytest.raises(ValueError, match="Unsupported"):
        readers.read_table(spark, write(tmp_path, "t.xml", "<a/>"))


def test_encoding(spark, tmp_path):
    latin = write(tmp_path, "latin.csv", "name\ncafé\n", "iso-8859-1")
    assert not readers.is_utf8(spark, latin) and readers.read_table(spark, latin).first().name == "café"
    assert readers.read_table(spark, write(tmp_path, "utf.csv", "name\ncafé\n")).first().name == "café"


def test_delimited_oddities(spark, tmp_path):
    signs = tmp_path / "signs.csv"
    signs.write_bytes("name,n\n5 €,1\n„ok“,2\n".encode("cp1252"))
    assert [r.name for r in readers.read_table(spark, str(signs)).orderBy("n").collect()] == ["5 €", "„ok“"]
    broken = write(tmp_path, "broken.csv", 'a,b\n1,"two\nlines, ""quoted"""\n2,plain\n')
    assert [tuple(r) for r in readers.read_table(spark, broken).orderBy("a").collect()] == [(1, 'two\nlines, "quoted"'), (2, "plain")]
    ragged = write(tmp_path, "ragged.csv", "a,b\n1\n2,x,y\n3,z\n")
    assert [tuple(r) for r in readers.read_table(spark, ragged).orderBy("a").collect()] == [(1, None), (2, "x"), (3, "z")]
    with pytest.raises(Exception):
        readers.read_table(spark, ragged, strict=True).collect()


def test_json(spark, tmp_path):
    array = readers.read_table(spark, write(tmp_path, "a.json", '\n [\n {"a": 1, "b": "x"},\n {"a": 2, "b": null}\n]'))
    lines = readers.read_table(spark, write(tmp_path, "l.json", '{"a": 1, "b": "x"}\n{"a": 2, "b": null}\n'))
    assert sorted(map(tuple, array.collect())) == sorted(map(tuple, lines.collect())) == [(1, "x"), (2, None)]
    with pytest.raises(Exception):
        readers.read_table(spark, write(tmp_path, "broken.json", '{"a": 1,\n')).collect()


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "Alpha"), (2, None)], "id bigint, name string")
    for kind in ("csv", "parquet", "json"):
        path = writers.export(df, f"{tmp_path}/out.{kind}", kind, compression="brotli")
        assert sorted(map(tuple, readers.read_table(spark, path).collect())) == [(1, "Alpha"), (2, None)]
    bare = writers.export(df, f"{tmp_path}/bare.csv", "CSV", columns=["id"], include_header=False)
    assert sorted(r[0] for r in spark.read.csv(bare).collect()) == ["1", "2"]
    with pytest.raises(ValueError):
        writers.export(df, f"{tmp_path}/x", "xlsx")
    with pytest.raises(ValueError):
        writers.export(df, f"{tmp_path}/y", "csv", columns=["zz"])


def test_versions(spark):
    store = VersionedTable(spark, scratch_dir(spark, "versions"))
    df = spark.createDataFrame([(1, " a "), (2, None), (2, None)], "id bigint, name string")
    assert store.create(df) == 1
    with pytest.raises(ValueError):
        store.create(df)
    assert store.apply("trim_whitespace") == 2 and store.apply("remove_duplicates") == 3
    assert store.read().count() == 2 and store.read(1).count() == 3
    assert store.branch(1, "trial") == 4 and store.apply("drop_missing") == 5
    assert store._row(5)["branch_name"] == "trial" and store.read(5).count() == 1
    store.restore(3)
    assert store.current() == 3
    with pytest.raises(ValueError):
        store.apply("drop_column", {"columns": ["zz"]})
    statuses = [r.status for r in store.runs().collect()]
    assert statuses[0] == "failed" and statuses.count("completed") == 3
    assert [r.version_number for r in store.versions().collect()] == [5, 4, 3, 2, 1]
    changes = {(r.kind, r.column): r["diff"] for r in store.compare(1, 5).collect()}
    assert changes[("row_count", None)] == -2 and changes[("null_count", "name")] == -2
    assert store.fingerprint(3).first() == fingerprint(store.replay(df, 3).repartition(3)).first()
    with pytest.raises(ValueError):
        store.read(9)


def test_stateless_operations_on_a_stream(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(batch.schema).parquet("/root/testdata/sf0.001/events*.parquet")
    steps = [
        make_transform("filter_rows", {"column": "event_type", "operator": "!=", "value": "click"}),
        CastType("user_id", "string"), make_transform("change_case", {"columns": ["event_type"], "case": "upper"}),
        make_transform("parse_dates", {"columns": ["ts"], "extract_components": ["year", "day_of_week"]}),
        make_transform("ordinal_encode", {"column": "event_type", "order": ["VIEW", "ERROR"]}),
    ]
    fill = FillStatistic("mean", ["value"])
    fitted = fill.fit(batch)
    expected = batch
    for t in steps:
        expected, stream = t.run(expected), apply_to_stream(stream, t, t.fit(expected))
    expected, stream = fill.apply(expected, fitted), apply_to_stream(stream, fill, fitted)
    out = f"{tmp_path}/out"
    stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(out).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, expected.collect()))


@pytest.mark.parametrize("check", ["nulls", "validation"])
def test_profile_stream_restart(spark, tmp_path, check):
    schema = "a double, b string"
    spark.createDataFrame([(1.0, None), (None, "x")], schema).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):
        profile_stream(read(), f"{tmp_path}/out", f"{tmp_path}/cp", check).awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out")
    assert rows.count() > 0
    if check == "nulls":
        assert rows.agg(F.sum("missing_count")).first()[0] == 2


def test_scratch_needs_a_shared_folder(spark):
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert run_transform(spark.range(5), "duplicate_column", {"source_column": "id", "new_column": "copy"}).columns == ["id", "copy"]


def test_mixed_json_folder(spark, tmp_path):
    folder = tmp_path / "mixed.json"
    folder.mkdir()
    (folder / "a.json").write_text('{"n": 1}\n{"n": 2}\n')
    (folder / "b.json").write_text('\n [\n  {"n": 3, "t": "x"},\n  {"n": 4}\n]\n')
    assert sorted(r["n"] for r in readers.read_json(spark, str(folder)).collect()) == [1, 2, 3, 4]
    assert readers.read_table(spark, str(folder)).filter("t = 'x'").count() == 1


def test_encoding_of_each_file(spark, tmp_path):
    folder = tmp_path / "texts.csv"
    folder.mkdir()
    (folder / "a.csv").write_bytes("k,t\n1,caf\u00e9\n".encode())
    (folder / "b.csv").write_bytes("k,t\n2,caf\u00e9\n".encode("latin-1"))
    df = readers.read_table(spark, str(folder))
    assert dict(df.dtypes)["k"] == "bigint"
    assert sorted((r["k"], r["t"]) for r in df.collect()) == [(1, "caf\u00e9"), (2, "caf\u00e9")]


def test_accumulated_stream(spark, tmp_path):
    """Parts of several batches merge into what one batch measures, also after a restart."""
    rows = [(i, float(i % 7) if i % 5 else None, "x" if i % 3 else None, float("nan")) for i in range(40)] * 2 + [(1, None, None, None)]
    table = spark.createDataFrame(rows, "i int, v double, t string, n double")
    table.repartition(3).write.parquet(f"{tmp_path}/in")
    run = lambda: accumulate_stream(
        spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/state", f"{tmp_path}/cp"
    ).awaitTermination()
    run()
    table.limit(10).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    whole = spark.read.parquet(f"{tmp_path}/in")
    expected = {r["column"]: r for r in profile_numeric(whole).collect()}
    for r in stream_totals(spark, f"{tmp_path}/state").collect():
        e = expected[r["column"]]
        assert (r["count"], r.missing_count) == (e["count"], e.missing_count)
        assert [r["mean"], r["std"], r["min"], r["max"]] == [None if x is None else pytest.approx(x) for x in (e["mean"], e["std"], e["min"], e["max"])]
    assert {r["column"]: r["q1"] for r in stream_quantiles(spark, f"{tmp_path}/state").collect()}["i"] == pytest.approx(expected["i"]["median"], abs=1)
    assert stream_duplicates(spark, f"{tmp_path}/state").first() == duplicate_count(whole).first()
