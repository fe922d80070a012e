"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def build_session(app_name: str = "tabwright", cores: str | None = None) -> SparkSession:
    """A session with the settings the operators rely on.

    On a cluster the master and the memory settings come from spark-submit; ``cores``
    is only given for local runs.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if cores is not None:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
            .config("spark.ui.enabled", "false")
        )
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder path below the shared folder named by ``spark.checkpoint.dir``.

    Where that setting is missing, a folder below ``spark.sql.warehouse.dir`` takes its
    place, because every executor reaches the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
