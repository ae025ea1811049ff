"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from moraine.plans import catalogue

HEADLINES = (
    "fit_kmeans", "fit_gmm", "fit_gmm_full", "fit_ward", "fit_hdbscan", "embedding_labels", "cf_diagonal", "cf_full", "assign_nearest",
    "outlier_scores", "representatives", "near_dup_pairs", "dds_quantiles", "kll_quantiles", "grid_micros", "lloyd_step", "gmm_e_step", "sparse_assign",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["fit_kmeans"](spark, sf_dir).collect()  # code is compiled and workers are started
    times = {}
    for name in HEADLINES:
        best = float("inf")
        for _ in range(2):
            t = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t)
        times[name] = round(best, 4)
    spark.stop()
    sf = float(os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf") or 0) if os.path.basename(os.path.normpath(sf_dir)).startswith("sf") else None
    print(json.dumps({"metric": "headline queries, best of 2", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
