"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "K4_idw_exposure", "D1_hourly_idw", "D4_day_metrics", "D5_legacy_weights",
    "K3_outliers_long", "K3_clean_panel", "K1_precedence_merge", "D6_wide_panel", "C7_densify",
    "E5_equal_population_groups", "D18_census_collapse", "D22_group_summary", "K6_gap_regression",
    "D10_completeness", "D11_exceedance_station_means", "D13_missing_by_hour", "K13_missing_by_quintile",
    "H12_reconcile_ids", "J5_haversine_pairs", "C19_nearest_neighbours", "C22_containing_unit",
    "K14_zonal_mean", "D31_correlations", "E11_runs_above", "D34_difference_summary", "K9_imputation",
    "A12_partitioned_sink",
]


def main() -> None:
    from checks import catalog

    from airgrid.session import get_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["D20_census_summary"](spark, folder).collect()  # warm the JVM
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
