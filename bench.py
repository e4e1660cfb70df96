"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Every
query is run in full into a sink that discards the rows. One small query warms up the JVM first
and is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

from firnline.catalog import QUERIES
from firnline.session import local_session

HEADLINE = [
    "flagship_daily_region_summary",
    "s02_write_read_training_table",
    "j01_microwave_with_optical",
    "j02_mask_filter_both",
    "j04_never_melting_cumulative",
    "j07_extended_feature_table",
    "j11_nearest_regrid",
    "j12_bilinear_regrid",
    "w02_w03_yesterday_and_week",
    "w04_focal_mean_9",
    "w09_distance_to_margin",
    "a05_bad_dates",
    "a10_mean_error_per_bin",
    "a14_histograms",
    "a17_qq_fit",
    "a18_anderson_darling",
    "a23_ensemble_statistics",
    "l05_nested_cv_ridge",
    "l13_decision_tree",
    "t01_incremental_ingest",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8, name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    QUERIES["p05_region_split"](spark, sf).collect()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
