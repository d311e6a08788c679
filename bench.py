"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tidewright import plans  # noqa: E402

HEADLINE = (
    "verify_by_lead", "quality_control", "hourly_grid", "accumulate", "acf", "valid_targets", "direct_origins", "feature_matrix",
    "extreme_verify", "rapid_rise_verify", "peak_verify", "residual_stats", "qq_points", "mad_filter", "pressure_gradient", "hourly_physics",
    "origin_physics", "regrid_bilinear", "type_lookup", "crawl_segments", "segment_summary", "station_path_nearest", "select_events",
    "peak_event_table", "ridge_select", "recursive_linear", "tide_harmonics", "block_bootstrap", "matched_keywords_documents", "read_track",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    available = plans.queries()
    plans.flagship(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    seconds = {}
    for name in names:
        start = time.perf_counter()
        available[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_wall_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
