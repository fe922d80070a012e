"""Records that go over lines, found by many tasks.

A file is read as lines, so each task works on one of its blocks. Where a record begins follows
from what the lines before it opened. Each block sums up what it does to that state, the sums of a
file's blocks are run through in order (one short row a block), and then every line knows its record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabwright.session import scratch_dir

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
# A line that starts outside of quotes and ends within a quoted cell. A quote opens a cell only at its start.
OPENS = rf'^(?:(?:{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+{_QUOTED}\z'
JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def _lines(spark: SparkSession, files: list[str], encoding: str) -> DataFrame:
    """``(file, block, line, value)``; ``line`` orders the lines of a block."""
    value = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    return spark.read.text(files, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), value.alias("value")
    )


def _written(blocks: DataFrame) -> DataFrame:
    path = scratch_dir(blocks.sparkSession, "blocks")
    blocks.write.parquet(path)
    return blocks.sparkSession.read.schema(blocks.schema).parquet(path)


def _joined(rows: DataFrame) -> DataFrame:
    """``(file, record, value)`` from lines that know their record."""
    parts = rows.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("parts"))
    return parts.select("file", "record", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"))


def _before(keys: list[str], order: str, what: Column) -> Column:
    """Sum over the rows before."""
    rows = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(what).over(rows), F.lit(0))


def _with_state(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``in0`` and ``in1``: the state before a row if it was 0 or 1 before the first row.

    ``to0`` and ``to1`` are the states after a row by the one before. A row whose two are equal sets
    the state, one that swaps them turns it; so the state is the last one set, turned as often
    as rows after that say.
    """
    rows = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turns = F.when((F.col("to0") == 1) & (F.col("to1") == 0), 1).otherwise(0)
    df = df.withColumn("turned", _before(keys, order, turns))
    fixed = F.when(F.col("to0") == F.col("to1"), (F.col("to0") + F.col("turned")) % 2)
    df = df.withColumn("fixed", F.last(fixed, ignorenulls=True).over(rows))
    return df.withColumns({f"in{x}": (F.coalesce("fixed", F.lit(x)) + F.col("turned")) % 2 for x in (0, 1)}).drop("turned", "fixed")


def csv_records(spark: SparkSession, files: list[str], encoding: str) -> tuple[DataFrame, list[str]]:
    """``(file, record, value)`` of the data records of delimited files with a header, and the files
    that this cannot cut: those with carriage returns that no line feed follows.

    Lines end with a line feed, with or without a carriage return before it. Blank lines between
    records are none. A quote that is never closed makes the rest of its file one record.
    """
    blank = F.col("value").isin("", "\r")
    lines = _lines(spark, files, encoding)
    lines = lines.withColumns({"to0": F.col("value").rlike(OPENS).cast("int"), "to1": F.concat(F.lit('"'), "value").rlike(OPENS).cast("int")})
    lines = _with_state(lines, ["file", "block"], "line")
    begins = {x: ((F.col(f"in{x}") == 0) & ~blank).cast("int") for x in (0, 1)}
    ends = {x: F.max_by(F.when(F.col(f"in{x}") == 0, F.col("to0")).otherwise(F.col("to1")), "line") for x in (0, 1)}
    blocks = lines.groupBy("file", "block").agg(
        *[ends[x].alias(f"to{x}") for x in ends], *[F.sum(begins[x]).alias(f"n{x}") for x in begins], F.count_if(F.col("value").rlike(r"\r(?!\z)")).alias("returns")
    )
    blocks = _with_state(blocks, ["file"], "block").withColumn("start", F.col("in0"))
    blocks = _written(blocks.withColumn("earlier", _before(["file"], "block", F.when(F.col("start") == 0, F.col("n0")).otherwise(F.col("n1")))).select("file", "block", "start", "earlier", "returns"))
    uncut = [r["file"] for r in blocks.groupBy("file").agg(F.sum("returns").alias("n")).filter("n > 0").collect()]
    so_far = {x: _before(["file", "block"], "line", begins[x]) + begins[x] for x in begins}
    placed = lines.withColumns({f"n{x}": so_far[x] for x in so_far}).join(blocks, ["file", "block"])
    inside = F.when(F.col("start") == 0, F.col("in0")).otherwise(F.col("in1")) == 1
    number = F.col("earlier") + F.when(F.col("start") == 0, F.col("n0")).otherwise(F.col("n1"))
    # The first record of a file is its header.
    rows = placed.filter(inside | ~blank).withColumn("record", number).filter(F.col("record") > 1)
    if uncut:
        rows = rows.filter(~F.col("file").isin(uncut))
    return _joined(rows).withColumn("value", F.regexp_replace("value", r"\r\z", "")), uncut


def json_elements(spark: SparkSession, files: list[str], encoding: str) -> DataFrame:
    """``(value)``: the elements of files that hold one JSON array each, as JSON on one line.

    Elements are cut apart at lines that start outside of every element; an array with no such
    line is one piece of work. Strings cannot hold a line break, so a line's brackets can be counted
    on their own. Brackets that do not close are an error.
    """
    bare = F.regexp_replace("value", JSON_STRING, "")
    depth = F.length(F.regexp_replace(bare, r"[^\[{]", "")) - F.length(F.regexp_replace(bare, r"[^\]}]", ""))
    lines = _lines(spark, files, encoding).filter(F.trim(F.regexp_replace("value", r"^\x{feff}|\r", "")) != "").withColumn("depth", depth)
    blocks = lines.groupBy("file", "block").agg(F.sum("depth").alias("depth"))
    blocks = _written(blocks.withColumn("start", _before(["file"], "block", F.col("depth"))))
    unclosed = blocks.groupBy("file").agg(F.sum("depth").alias("n")).filter("n <> 0").first()
    if unclosed:
        raise ValueError(f"{unclosed['file']}: the brackets of the array do not close")
    level = F.col("start") + _before(["file", "block"], "line", F.col("depth"))
    lines = lines.join(blocks.select("file", "block", "start"), ["file", "block"]).withColumn("level", level)
    # A piece is named by the line that it begins with; pieces that go over blocks find theirs by the block before.
    begins = F.when(F.col("level") <= 1, F.struct("block", "line"))
    within = Window.partitionBy("file", "block").orderBy("line")
    lines = lines.withColumn("begin", F.last(begins, ignorenulls=True).over(within))
    last = _written(lines.groupBy("file", "block").agg(F.max_by("begin", "line").alias("begin")))
    carried = F.last("begin", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.join(last.select("file", "block", carried.alias("carried")), ["file", "block"]).withColumn("record", F.coalesce("begin", "carried"))
    outer = F.max(F.when(F.col("level") == 0, 1).otherwise(0)).alias("opens")
    closes = F.max(F.when(F.col("level") + F.col("depth") == 0, 1).otherwise(0)).alias("closes")
    pieces = lines.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("parts"), outer, closes)
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    text = F.when(F.col("opens") == 1, F.regexp_replace(text, r"^\x{feff}?\s*\[", "")).otherwise(text)
    pieces = pieces.select(text.alias("text"), "closes")
    text = F.when(F.col("closes") == 1, F.regexp_replace("text", r"\]\s*\z", "")).otherwise(F.col("text"))
    text = F.regexp_replace(F.regexp_replace(text, r"^[\s,]++", ""), r"[\s,]++\z", "")
    elements = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", {"mode": "FAILFAST"})
    return pieces.select(F.explode(elements).alias("value"))
