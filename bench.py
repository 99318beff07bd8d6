"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8)
choose data and cores. Every query runs once unmeasured, then its best of
``BENCH_RUNS`` (default 2) full evaluations is kept. Building the plan counts.
With ``BENCH_DUCKDB=1`` the check SQL is timed in DuckDB next to it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from meterlens.catalog import QUERIES  # noqa: E402
from meterlens.session import build_session  # noqa: E402

HEADLINE = [
    "hourly_profile", "kpi_overview", "time_features", "building_fill", "weather_fill",
    "enriched_readings", "lag_features", "rolling_features", "feature_matrix",
    "chronological_split", "lookback_sequences", "site_week_sequences", "tail_readings",
    "hourly_regularise", "heatmap", "top_buildings", "model_metrics", "leaderboard",
    "aligned_predictions", "weighted_ensemble", "stacked_ensemble", "error_histogram",
    "first_predictions", "zscore_anomalies", "severity", "severity_counts", "recent_alerts",
    "peak_shaving", "peak_shaving_by_building", "solar_netload_by_site", "stagger_profile",
    "strategy_a_by_building", "strategy_b_by_site", "strategy_c_by_building",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            # Small data: keep all cores busy instead of merging partitions.
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timed, duck = {}, {}
    for name in names:
        best = None
        for attempt in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            seconds = time.perf_counter() - started
            if attempt and (best is None or seconds < best):
                best = seconds
        timed[name] = round(best, 3)
    if os.environ.get("BENCH_DUCKDB"):
        from tests.oracle import connect

        con = connect(folder)
        for name in names:
            if QUERIES[name].sql:
                started = time.perf_counter()
                con.sql(QUERIES[name].sql).arrow()
                duck[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    line = {
        "metric": "headline_queries_total", "value": round(sum(timed.values()), 3), "unit": "sec",
        "queries": timed, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    if duck:
        line["duckdb"] = duck
    print(json.dumps(line))


if __name__ == "__main__":
    main()
