"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tabwright import build_session  # noqa: E402
from tabwright.plans.suite import QUERIES  # noqa: E402

HEADLINE = [
    "fill_missing_mean", "fill_missing_median", "fill_missing_mode", "profile_numeric", "profile_histogram", "profile_categorical",
    "top_values", "quality_issues", "health_score", "duplicate_count", "remove_duplicates", "dedup_subset_first", "sort_rows", "page_rows",
    "cast_integer", "cast_date", "trim_whitespace", "standard_scale", "outliers_iqr_clip", "outliers_iqr_remove", "one_hot_encode",
    "train_test_split", "validation_report", "contract_report", "ml_readiness", "chart_kde", "chart_grouped_box", "chart_corr_pearson",
    "chart_corr_spearman", "read_csv", "version_fingerprint",
]


def run(spark, name: str, sf_dir: str) -> float:
    """Seconds to compute all rows of a query."""
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("OFF")
    times = {}
    run(spark, "null_counts", sf_dir)  # start-up is not part of the measurement
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        run(spark, name, sf_dir)
        times[name] = round(run(spark, name, sf_dir), 4)
    spark.stop()
    scale = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": float(scale)}))


if __name__ == "__main__":
    main()
