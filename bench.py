"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "daily_demand_capped", "delivery_stats", "lag1_accuracy", "lag_features", "rolling_features", "ewm_features", "days_since",
    "holiday_features", "baseline_calibrated", "wape_10d", "tune_threshold", "batch_forecast", "stock_ledger",
    "slot_assignment", "event_outcomes", "chariot_split", "tour_totals",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    from skuflow.plans.registry import QUERIES
    from skuflow.session import local_session

    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start-up is not a query's time
    seconds: dict[str, float] = {}
    for name in names:
        started = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
