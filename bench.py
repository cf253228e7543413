"""Headline queries on local cores: prints one JSON line.

``experiments`` is the counterpart of the published reference timing (train and evaluate all
models); the others are the data stages before and after it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "hourly_last_value",
    "station_grid_gapfill",
    "interpolation_sweep",
    "quality_audit",
    "normalised_observations",
    "gap_statistics",
    "sampling_interval",
    "areal_mean",
    "station_feature_matrix",
    "persistence_metrics",
    "train_mean_metrics",
    "high_level_thresholds",
    "event_metrics",
    "peak_diagnostics",
    "warning_lead",
    "event_errors",
    "common_support_metrics",
    "asof_latest",
    "station_bundle",
    "dataset_digest",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tidemark.operators import models
    from tidemark.plans.stage import remove_stored, stored
    from workload import queries

    def run(frame) -> None:
        frame.write.format("noop").mode("overwrite").save()

    def experiments() -> None:
        matrix = stored(queries.matrix(spark, sf), "features")
        run(models.experiment_scores(stored(models.run_experiments(matrix, parallel=int(cpus)), "predictions")))

    run(queries.table(spark, sf, "events"))
    times: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        run(queries.QUERIES[name](spark, sf))
        times[name] = round(time.perf_counter() - began, 3)
    began = time.perf_counter()
    experiments()
    times["experiments"] = round(time.perf_counter() - began, 3)
    remove_stored(spark)
    spark.stop()
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}
        )
    )


if __name__ == "__main__":
    main()
