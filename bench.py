"""Wall-clock seconds of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3,
the median counts), BENCH_QUERIES (comma-separated names, default the headline set).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from panelyard.cases import load_cases  # noqa: E402
from panelyard.plans import release  # noqa: E402
from panelyard.session import local_session  # noqa: E402

HEADLINE = [
    "r4_dense_panel",
    "w1_lags",
    "w3_rolling_means",
    "e2_mean_encodings",
    "w_all_panel_features",
    "a8_describe",
    "e6_median_imputation",
    "t1_train_test",
    "t4_stratified_k_fold",
    "k1_pearson",
    "k2_spearman",
    "k8_mutual_information",
    "k10_seasonal_cycles",
    "v1_panel_baseline",
    "v3_macro_metrics",
    "n1_isolation_forest",
    "w12_sliding_windows_events",
    "l1_linear_regression_all",
    "l12_recursive_forecast",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries = load_cases()[0]
    seconds = {}
    for name in names:
        taken = []
        # The first run of each query also warms the JVM and is not counted.
        for i in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            if i:
                taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf")}))
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
