"""Reading CSV, JSON and Parquet into typed DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabwright.functions.columns import col, string_columns
from tabwright.functions.text import NUMBER, WHOLE_NUMBER, null_tokens_to_null
from tabwright.session import scratch_dir
from tabwright.sources.records import csv_records, json_elements

CORRUPT = "_corrupt_record"
BOOLEAN_TEXT = "(?i)^(?:true|false)$"
UTF8, FALLBACK_ENCODING = "UTF-8", "ISO-8859-1"
# Bytes 80 to 9f are control characters in ISO-8859-1, but signs and letters in windows-1252.
_BYTES = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
CONTROLS, SIGNS = "".join(map(chr, _BYTES)), bytes(_BYTES).decode("cp1252")


def null_tokens(df: DataFrame) -> DataFrame:
    """Texts that stand for "missing" become null in every string column."""
    texts = set(string_columns(df))
    return df.select(*[null_tokens_to_null(col(c)).alias(c) if c in texts else col(c) for c in df.columns])


def infer_types(df: DataFrame) -> dict[str, str]:
    """The narrowest type that fits all values of each string column, from one aggregation.

    Tried in this order: bigint, double, boolean, string. Dates stay text.
    """
    texts = string_columns(df)
    aggs: list[Column] = []
    for i, c in enumerate(texts):
        x = col(c)
        aggs += [
            F.count(x).alias(f"n{i}"),
            F.count(F.when(x.rlike(WHOLE_NUMBER), x.try_cast("bigint"))).alias(f"bigint{i}"),
            F.count(F.when(x.rlike(NUMBER), x.try_cast("double"))).alias(f"double{i}"),
            F.count_if(x.rlike(BOOLEAN_TEXT)).alias(f"boolean{i}"),
        ]
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    if not texts:
        return types
    row = df.agg(*aggs).first()
    for i, c in enumerate(texts):
        fits = [t for t in ("bigint", "double", "boolean") if row[f"n{i}"] and row[f"{t}{i}"] == row[f"n{i}"]]
        types[c] = fits[0] if fits else "string"
    return types


def apply_types(df: DataFrame, types: dict[str, str], strict: bool = True) -> DataFrame:
    """Cast to the given types. Strict casts fail the job on a bad cell, others give null."""

    def typed(c: str) -> Column:
        return col(c) if types[c] == "string" else col(c).cast(types[c]) if strict else col(c).try_cast(types[c])

    return df.select(*[typed(c).alias(c) for c in df.columns])


def _text_schema(schema: str | T.StructType) -> tuple[T.StructType, dict[str, str]]:
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return T.StructType([T.StructField(f.name, T.StringType()) for f in declared]), {f.name: f.dataType.simpleString() for f in declared}


def _raw_csv(spark: SparkSession, path: str | list[str], encoding: str, multi_line: bool = False, schema: T.StructType | None = None, mode: str = "FAILFAST") -> DataFrame:
    raw = spark.read.csv(path, schema=schema, header=True, mode=mode, encoding=encoding, multiLine=multi_line, escape='"')
    if encoding == FALLBACK_ENCODING:
        raw = raw.select(*[F.translate(col(c), CONTROLS, SIGNS).alias(c) for c in raw.columns])
    return null_tokens(raw)


def read_csv(
    spark: SparkSession, path: str, encoding: str = UTF8, multi_line: bool = False, schema: str | T.StructType | None = None,
) -> DataFrame:
    """Delimited text with a header row; a malformed row or cell is an error.

    Types come from all rows, which costs one more pass over the files, or from ``schema``.
    Cells with line breaks need ``multi_line``, which reads each file in one task.
    """
    texts, types = _text_schema(schema) if schema is not None else (None, None)
    raw = _raw_csv(spark, path, encoding, multi_line, texts)
    return apply_types(raw, types or infer_types(raw))


def read_csv_permissive(spark: SparkSession, path: str, schema: str | T.StructType, encoding: str = UTF8) -> DataFrame:
    """Delimited text read with declared types: a cell that does not fit is null, a row with
    the wrong number of cells is kept as far as it goes."""
    texts, types = _text_schema(schema)
    raw = spark.read.csv(path, schema=texts.add(CORRUPT, "string"), header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, encoding=encoding, escape='"')
    return apply_types(null_tokens(raw.drop(CORRUPT)), types, strict=False)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _files_where(spark: SparkSession, path: str | list[str], told: Column) -> dict[str, list[str]]:
    """The files of a path by what an aggregate says of their lines (``value`` in order ``place``).

    One aggregation over all lines; the driver gets one short row per file.
    """
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"), "value"
    )
    found: dict[str, list[str]] = {}
    for r in lines.groupBy("file").agg(told.alias("kind")).collect():
        found.setdefault(r["kind"] or "", []).append(unquote(r["file"]))
    return found


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_json(spark: SparkSession, path: str | list[str], encoding: str = UTF8) -> DataFrame:
    """Files that hold an array of objects, or one object per line; each file is told apart by
    its own first character, and a folder may mix both.

    Arrays are cut into their elements by many tasks and written once, one object per line, to
    the shared scratch folder. A comma that is missing or surplus between two lines of an array is
    not noticed; brackets that do not close, and elements that are no JSON, are errors.
    """
    start = F.substring(F.ltrim("value"), 1, 1)
    files = _files_where(spark, path, F.min_by(start, F.when(start != "", F.col("place"))))
    arrays = files.pop("[", [])
    lines = [f for own in files.values() for f in own]
    parts = []
    if arrays:
        own = scratch_dir(spark, "elements")
        json_elements(spark, arrays, encoding).write.text(own)
        parts.append(read_ndjson(spark, own))
    return _union(parts + ([read_ndjson(spark, lines, encoding)] if lines or not parts else []))


def read_ndjson(spark: SparkSession, path: str | list[str], encoding: str = UTF8) -> DataFrame:
    return spark.read.json(path, encoding=encoding, mode="FAILFAST")


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv": read_csv, "txt": read_csv, "parquet": read_parquet, "json": read_json, "ndjson": read_ndjson, "jsonl": read_ndjson,
}


def _csv_table(spark: SparkSession, path: str, strict: bool) -> DataFrame:
    """Delimited text whose files may differ in encoding and in having line breaks within quotes.

    A line with an odd number of quotes may open or close a cell that goes over lines. Files with
    such lines are cut into records by many tasks.
    """
    odd = F.pmod(F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit(""))), F.lit(2)) == 1
    broken = F.when(F.bool_or(odd), F.lit(" broken")).otherwise(F.lit(""))
    kinds = sorted(_files_where(spark, path, F.concat(_encoding(), broken)).items()) or [(UTF8, [path])]
    mode = "FAILFAST" if strict else "PERMISSIVE"
    parts = []
    for kind, files in kinds:
        encoding = kind.removesuffix(" broken")
        parts += [_raw_csv(spark, files, encoding, mode=mode)] if kind == encoding else _broken_csv(spark, files, encoding, mode)
    raw = _union(parts)
    return apply_types(raw, infer_types(raw))


def _broken_csv(spark: SparkSession, files: list[str], encoding: str, mode: str) -> list[DataFrame]:
    """Files with line breaks within cells, by their records. A file whose lines end with carriage
    returns alone is read in one task."""
    header = spark.read.csv(files, header=True, encoding=encoding, multiLine=True, escape='"').columns
    records, uncut = csv_records(spark, files, encoding)
    own = scratch_dir(spark, "records")  # types are looked for in all rows, so records would be cut twice
    records.select("value").write.parquet(own)
    records = spark.read.schema("value string").parquet(own)
    cells = ", ".join(f"c{i} string" for i in range(len(header)))
    row = F.from_csv("value", cells, {"escape": '"', "mode": mode, "multiLine": "true"})
    cut = records.select(row.alias("r")).select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(header)])
    if encoding == FALLBACK_ENCODING:
        cut = cut.select(*[F.translate(col(c), CONTROLS, SIGNS).alias(c) for c in header])
    whole = [_raw_csv(spark, [unquote(f) for f in uncut], encoding, True, mode=mode)] if uncut else []
    return whole + ([null_tokens(cut)] if len(uncut) < len(files) else [])


def _encoding() -> Column:
    return F.when(F.bool_and(F.is_valid_utf8("value")), UTF8).otherwise(FALLBACK_ENCODING)


def read_table(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Read by file extension; an empty table is an error.

    Each file is read in its own encoding. A row of delimited text with too few cells is filled
    with nulls and one with too many loses those beyond the header, unless ``strict`` makes
    either an error.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1]
    extension = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if extension not in READERS:
        raise ValueError(f"Unsupported ending .{extension}; files of {', '.join(READERS)} are read")
    if extension in ("csv", "txt"):
        df = _csv_table(spark, path, strict)
    elif extension == "json":
        parts = sorted(_files_where(spark, path, _encoding()).items()) or [(UTF8, [path])]
        df = _union([read_json(spark, files, encoding) for encoding, files in parts])
    else:
        df = READERS[extension](spark, path)
    return assert_non_empty(df)


def assert_non_empty(df: DataFrame) -> DataFrame:
    if not df.columns:
        raise ValueError("a table of 0 columns holds nothing")
    if df.isEmpty():
        raise ValueError("a table of 0 rows holds nothing")
    return df


def encoding_audit(spark: SparkSession, path: str) -> DataFrame:
    """``(file, lines, invalid_lines, encoding)`` per file: UTF-8 when every line is valid.

    Works on lines, so a large file is checked by many tasks.
    """
    lines = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), "value")
    per_file = lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count_if(~F.is_valid_utf8("value")).alias("invalid_lines"))
    return per_file.withColumn("encoding", F.when(F.col("invalid_lines") == 0, UTF8).otherwise(FALLBACK_ENCODING))


def is_utf8(spark: SparkSession, path: str) -> bool:
    return spark.read.text(path).filter(~F.is_valid_utf8("value")).isEmpty()


def table_metadata(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type and the size of the table."""
    rows = df.count()
    made = [(i, f.name, f.dataType.simpleString(), rows, len(df.columns)) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(made, "position bigint, column string, data_type string, row_count bigint, column_count bigint")
