"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores. Each query runs to
completion over its whole result, after one short warm-up of the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tsweave.plans.catalog import QUERIES
from tsweave.session import local_session

HEADLINE = [
    "clean_numeric", "parse_dates_first_match", "parse_dates_most_specific", "null_counts", "hour_profile_mean",
    "lag_rolling_features", "warmup_drop", "split_ceil_overlap", "minmax_fit_apply", "split_sliding_windows",
    "acf_20", "pacf_20", "adf_auto", "ar1_forecast", "arima_grid", "arima_eval", "persistence_eval",
    "baseline_compare", "linear_window_forecast_12", "sequence_eval", "rf_eval", "gbt_eval",
    "save_load_forecast", "panel_union", "long_series_features",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "tsweave-bench")
    QUERIES["persistence_eval"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cores": cores,
                "spark": spark.version,
                "state": "warm session, one run per query",
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
