"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS``
the timed runs per query (the median counts, after one warm-up).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "C8_training_set",
    "J1_with_position",
    "J1_with_position_chunked",
    "J2_align_series",
    "J4_compare_series",
    "W1_value_runs",
    "A3_profile_numeric",
    "A6_quantiles",
    "A6_quantiles_by_bucket",
    "A7_iqr_outliers",
    "A11_correlation",
    "A14_histogram",
    "C1_validate_actions",
    "C3_validate_rewards",
    "C4_validate_observations",
    "C5_validate_weather",
    "S1_read_table",
    "S5_building_objects",
    "J5_zone_adjacency_by_name",
    "J8_zone_windows",
    "J11_zone_hvac",
    "J13_zone_infiltration",
    "D7_hunting",
    "M1_keyword_scores",
    "M6_vector_health",
)


def main() -> None:
    from bindings import QUERIES
    from hearthline.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINES:
        taken = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
