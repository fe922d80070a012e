"""Transforms and checks on Structured Streaming DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tabwright.functions.columns import col, normalize_non_finite, numeric_columns
from tabwright.operators.base import Fitted, Transform
from tabwright.operators.dedup import comparable
from tabwright.operators.profile import null_counts
from tabwright.operators.quantiles import SKETCH_SIZE
from tabwright.operators.validate import validation_issues

CHECKS: dict[str, Callable[[DataFrame], DataFrame]] = {"nulls": null_counts, "validation": validation_issues}


def apply_to_stream(stream: DataFrame, transform: Transform, fitted: Fitted | None = None) -> DataFrame:
    """A transform fitted on a batch table (or a stateless one), applied to a stream."""
    return transform.apply(transform.prepare(stream), {} if fitted is None else fitted)


def profile_stream(stream: DataFrame, out: str, checkpoint: str, check: str = "nulls") -> StreamingQuery:
    """Profile or validate each micro-batch and append the rows to ``out``.

    A repeated batch overwrites its own folder, so a restart does not double its rows.
    """
    measure = CHECKS[check]

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            measure(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accumulate_stream(stream: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Keep a state of the whole stream that merges: moments, bounds and quantile sketches of the
    numbers per micro-batch, and how often each row occurs, by a 128-bit hash.

    Every batch writes its part once, in a folder of its own, so a repeated batch replaces it.
    ``stream_totals``, ``stream_quantiles`` and ``stream_duplicates`` merge the parts. NaN and
    infinities are missing.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        df = normalize_non_finite(batch)
        facts = []
        for i, c in enumerate(numeric_columns(df)):
            x = col(c).cast("double")
            facts.append(F.struct(
                F.lit(i).cast("bigint").alias("position"), F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count(x).alias("present"), F.avg(x).alias("mean"),
                (F.var_pop(x) * F.count(x)).alias("squares"), F.min(x).alias("low"), F.max(x).alias("high"), F.kll_sketch_agg_double(x, F.lit(SKETCH_SIZE)).alias("sketch"),
            ))
        if facts:
            df.agg(F.array(*facts).alias("facts")).select(F.inline("facts")).write.mode("overwrite").parquet(f"{state}/numbers/batch_id={batch_id}")
        keys = [comparable(f.name, f.dataType) for f in df.schema]
        hashed = df.select(F.xxhash64(*keys).alias("h1"), F.xxhash64(F.lit(1), *keys).alias("h2"))
        hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{state}/rows/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts(spark: SparkSession, state: str) -> DataFrame:
    return spark.read.parquet(f"{state}/numbers")


def stream_totals(spark: SparkSession, state: str) -> DataFrame:
    """One row per numeric column over all batches so far: ``count`` (rows), ``missing_count``,
    ``mean``, ``std``, ``min``, ``max``. Squares are added around the common mean, so nothing
    cancels; a column without values has none of the last four."""
    parts = _parts(spark, state)
    mean = parts.groupBy("column").agg((F.sum(F.col("mean") * F.col("present")) / F.nullif(F.sum("present"), F.lit(0))).alias("whole"))
    off = F.col("mean") - F.col("whole")
    merged = parts.join(mean, "column").groupBy("column").agg(
        F.sum("rows").alias("count"), F.sum(F.col("rows") - F.col("present")).alias("missing_count"), F.max("whole").alias("mean"),
        F.sqrt(F.sum(F.col("squares") + F.col("present") * off * off) / F.nullif(F.sum("present"), F.lit(0))).alias("std"),
        F.min("low").alias("min"), F.max("high").alias("max"),
    )
    return merged.select("column", "count", "missing_count", "mean", "std", "min", "max")


def stream_quantiles(spark: SparkSession, state: str, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``(column, q0, q1, ...)`` from the merged sketches. The rank of a value is off by at most
    0.07 % of the rows with 99 % confidence; exact quantiles need the rows again."""
    merged = _parts(spark, state).filter("present > 0").groupBy("column").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select("column", *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(f"q{i}") for i, p in enumerate(probs)])


def stream_duplicates(spark: SparkSession, state: str) -> DataFrame:
    """Rows and surplus copies over all batches. Rows are told apart by 128 bits of hash."""
    copies = spark.read.parquet(f"{state}/rows").groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    return copies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.col("n") - F.lit(1)), F.lit(0)).alias("duplicate_count"))
