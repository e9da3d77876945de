"""Benchmark the headline queries.

Runs each query once to warm up, then three timed runs, and reports the median.
Each run executes the whole plan through the ``noop`` sink (nothing is collected
to the driver).  Prints ONE JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES (comma list, default: the headline set), BENCH_RUNS (default 3)
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "attribution_comparison",
    "attribution_credits",
    "attribution_credits_user_scope",
    "eligible_pairs",
    "dedup_touchpoints",
    "journey_lag_lead",
    "assisted_conversions",
    "campaign_attribution",
    "near_duplicate_1s",
    "geo_incrementality",
    "geo_significance",
    "bootstrap_lift",
    "overview_metrics",
    "scenario_grid",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]

    from creditline.plans.registry import all_queries
    from creditline.session import build_session

    spark = build_session(
        f"local[{cpus}]",
        app_name="creditline-bench",
        shuffle_partitions=cpus * 2,
        conf={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")},
    )
    qs = all_queries()
    timings: dict[str, float] = {}
    shuffles: dict[str, int] = {}
    for name in names:
        fn = qs[name]

        def run() -> float:
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        run()  # warm-up
        timings[name] = round(statistics.median(run() for _ in range(runs)), 3)
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        shuffles[name] = len(re.findall(r"Exchange (hash|range|single|round)", plan))
    sf = re.search(r"sf([0-9.]+)$", sf_dir)
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "shuffles": shuffles,
        "sf": float(sf.group(1)) if sf else sf_dir,
        "cores": cpus,
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
