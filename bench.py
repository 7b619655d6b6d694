"""Seconds per headline query: prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 8), ``BENCH_QUERIES`` (comma list).
Each query runs into a no-op sink, so every column of every row is produced.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import CHECKS  # noqa: E402
from checks.compare import session  # noqa: E402

HEADLINE = ("qc_temperature", "cell_hour_mean", "memory_features", "deaccumulate", "bilinear_fill", "dynamic_features", "feature_matrix",
            "block_stats", "class_fractions", "ring_dev", "region_mask", "knn_stations", "idw_anchor", "anchor_hourly_lz", "gauss_anchor",
            "anchor_rule_table", "skill_by_strata", "band_coverage", "exact_quantiles", "error_histogram", "bootstrap_ci", "derived_physics",
            "gbt_out_of_fold", "forest_band")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.format("noop").mode("overwrite").save()      # start the executors
    seconds = {}
    for name in names:
        t0 = time.perf_counter()
        CHECKS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t0, 3)
        spark.catalog.clearCache()
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
