"""Helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabwright.session import scratch_dir

# Rows and bytes that one Arrow batch hands to a Python worker. Texts may be long, so
# batches are small; a single row may still exceed the bytes.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` only, so that no further column can clash; a null text is empty."""
    return df.select(column(id_col).cast("bigint").alias("doc_id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written once to the shared scratch folder and read from there.

    Cuts the lineage: a lost executor costs the tasks it was running, not the job that made
    the table.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows of a written table that may be broadcast; at some 100 bytes a row, about 20 MB.
BROADCAST_ROWS = 200_000


def small_side(table: DataFrame) -> DataFrame:
    """A written table as the smaller side of a join: broadcast if its counted rows are few,
    so that texts stay where they are; else the join is left to shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
