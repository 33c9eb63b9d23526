"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up, then RUNS times; the median is reported.  The
whole result is produced (a no-op sink), nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from foldloom.catalog import QUERIES
from foldloom.session import build_session

RUNS = 3
HEADLINE = [
    "baseline_fold_metrics", "cross_fold_summary", "impute_mean", "impute_median", "impute_mode",
    "clip_infinite", "label_encode", "target_encode", "target_encode_oof", "frequency_encode",
    "standard_scale", "robust_scale", "log_normalise", "row_stats", "pair_interactions",
    "unary_features", "manual_features", "equal_freq_bins", "quality_report", "meta_features",
    "shuffled_kfold", "stratified_kfold_events", "best_per_dataset", "score_boxplot", "robust_score",
    "early_stop_point", "hp_scale", "trial_candidates", "ridge_cv", "knn_regress",
]
MODELS = ["tree_cv", "forest_cv", "search_best"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("foldloom-bench", f"local[{cores}]", shuffle_partitions=int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in [*HEADLINE, *MODELS]:
        times = []
        for _ in range(1 + (1 if name in MODELS else RUNS)):
            spark.catalog.clearCache()
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "spark": spark.version,
                "master": f"local[{cores}]",
                # the planning constant of the baseline is 30 s per search trial
                "seconds_per_search_trial": round(seconds["search_best"] / 6, 3),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
