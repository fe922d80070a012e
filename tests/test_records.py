"""Files whose records go over lines, cut at any byte."""

import csv
import io
import json
import random

import pytest

from tabwright.sources import readers


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    yield lambda size: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(size)), spark.conf.set("spark.sql.files.openCostInBytes", "0"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def cells(rng):
    return "".join(rng.choice(["a", "b", ",", '"', "\n", '""', " ", "é", "\n\n", '",', ',"']) for _ in range(rng.randrange(1, 12))) + "z"


@pytest.mark.parametrize(("size", "ending", "encoding"), [(40, "\n", "utf-8"), (97, "\r\n", "utf-8"), (64, "\n", "latin-1"), (1 << 20, "\n", "utf-8")])
def test_quoted_line_breaks(spark, tmp_path, small_blocks, size, ending, encoding):
    rng = random.Random(size)
    folder, expected = tmp_path / "cells.csv", []
    folder.mkdir()
    for k in range(3):
        rows = [(k * 1000 + i, cells(rng), cells(rng)) for i in range(60)]
        out = io.StringIO()
        csv.writer(out, lineterminator=ending).writerows([("k", "x", "y"), *rows])
        (folder / f"{k}.csv").write_bytes(out.getvalue().encode(encoding))
        expected += rows
    small_blocks(size)
    df = readers.read_table(spark, str(folder))
    assert dict(df.dtypes)["k"] == "bigint"
    assert sorted(map(tuple, df.collect())) == expected
    lines = readers._files_where(spark, str(folder), readers.F.count_distinct(readers.F.col("place.file_block_start")).cast("string"))
    assert min(map(int, lines)) > 1


def test_blank_lines_bare_quotes_and_carriage_returns(spark, tmp_path, small_blocks):
    small_blocks(16)
    (tmp_path / "t.csv").write_bytes(b'\n"k",t\n\n1,5" pipe\n\n2,"two\n\nlines"\n3,\n4,"\n"\n')
    rows = sorted(map(tuple, readers.read_table(spark, str(tmp_path / "t.csv")).collect()))
    assert rows == [(1, '5" pipe'), (2, "two\n\nlines"), (3, None), (4, "\n")]
    (tmp_path / "old.csv").write_bytes(b'k,t\r1,"a\rb"\r2,c\r')
    assert sorted(r["k"] for r in readers.read_table(spark, str(tmp_path / "old.csv")).collect()) == [1, 2]
    (tmp_path / "ragged.csv").write_bytes(b'k,t\n1,"a\nb"\n2\n3,x,y\n')
    assert sorted(map(tuple, readers.read_table(spark, str(tmp_path / "ragged.csv")).collect()))[1:] == [(2, None), (3, "x")]
    with pytest.raises(Exception):
        readers.read_table(spark, str(tmp_path / "ragged.csv"), strict=True).collect()


@pytest.mark.parametrize("indent", [None, 0, 2])
def test_json_arrays(spark, tmp_path, small_blocks, indent):
    rng = random.Random(7)
    rows = [{"k": i, "t": rng.choice(['x]', '{"', "\\", 'a\\"}', "\n[", "é"]) * (i % 3), "in": {"v": [i, {"w": "}"}]}} for i in range(80)]
    small_blocks(50)
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent))
    found = readers.read_table(spark, str(tmp_path / "a.json")).orderBy("k").collect()
    assert [(r["k"], r["t"], r["in"]["v"][0]) for r in found] == [(r["k"], r["t"], str(r["k"])) for r in rows]
    if indent:
        (tmp_path / "cut.json").write_text(json.dumps(rows, indent=indent)[:-3])
        with pytest.raises(ValueError, match="do not close"):
            readers.read_table(spark, str(tmp_path / "cut.json"))
