"""Headline queries, timed on local Spark. Prints one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times (median is reported); every row is computed and
discarded. Tables the serving queries read as published are built before the clock starts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

HEADLINE = (
    "a03_provision_per_place", "a04_room_screen", "a05_level_pressure", "a06_enrollment_trend", "a09_priority_matrix", "a11_price_fences_by_type",
    "a12_sensitivity", "c12_quarantine_reasons", "c14_duplicate_key_count", "c15_copies_and_conflicts", "c30_carry_over_whole_table", "c35_hierarchy_from_sums",
    "d21_entity_worklist", "g07_melt_levels", "i03_tiered_resolver", "i12_point_in_boundary", "i14_match_distinct_names", "k03_exact_quantiles",
    "p01_column_profile", "q06_independent_recomputation", "q31_current_results", "s12_insert_only_merge", "s21_content_hash", "w02_position_in_table",
)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))

    from placegrid import queries
    from placegrid.queries.star import BUILDERS, published
    from placegrid.session import build_session

    spark = build_session("bench", cpus, shuffle_partitions=int(cpus), driver_memory="16g")
    registered = queries.all_queries()
    for table in BUILDERS:
        published(spark, sf_dir, table)

    def once(query) -> float:
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        once(registered[name])
        seconds[name] = round(statistics.median(once(registered[name]) for _ in range(runs)), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
