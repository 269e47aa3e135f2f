"""Time the headline queries; prints one JSON line.

Each query is run once untimed and then ``BENCH_RUNS`` times; the best run counts.
A run includes building the plan and writing every row to a ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "floor_30min",
    "level_flags",
    "zscore_outlier_filter",
    "outdoor_only_filter",
    "summary_value_mode",
    "summary_rollup_mode",
    "cell_stats_30min",
    "harmful_share_weighted",
    "harmful_cell_share",
    "epa_daily_agg",
    "purpleair_daily_agg",
    "point_in_polygon_join",
    "geotag_layers",
    "hex_assign",
    "polygon_intersects_join",
    "within_radius_join",
    "top_decile_flag",
    "table_profile",
    "numeric_describe",
    "histogram",
    "density_curve",
    "five_number_summary",
    "quantile_bins",
    "prepare_train_test",
    "row_id_within_filter",
    "daily_comparison",
    "near_sensor_daily",
    "neighborhood_blocks",
    "incremental_refresh",
    "stream_cell_stats",
)


def main() -> None:
    from hazegrid.catalog import load_all
    from hazegrid.session import build_session, drop_staged

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_all()
    times = {}
    for name in HEADLINE:
        best = None
        for run in range(runs + 1):
            started = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - started
            if run:
                best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    drop_staged(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
