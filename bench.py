"""Time the headline queries on local Spark and print one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "session_funnel", "session_funnel_anchored", "position_ctr_cvr", "conversion_within", "attribute_surface",
    "exposure_windows", "assign_variant", "assign_variant_closed", "date_theta_join", "scd2_point_in_time_join",
    "interval_join", "nearest_follow_up", "time_gap_buckets", "cross_sell_rate", "subsequent_orders", "retention_flag",
    "range_window_activity", "conditional_count_distinct", "composite_count_distinct", "fanout_safe_sum",
    "percentiles_by_group", "percent_rank_trim", "cumulative_share", "rank_dense_and_average", "box_stats", "histogram",
    "last_entry_per_key", "drop_all_duplicates", "unpack_instructions", "reconcile", "not_in_subquery",
    "dimension_chain", "placed_products", "gmv_loss", "category_penetration", "category_mix", "metrics_per_unit",
    "cumulative_observations", "ab_test_by_group", "multi_metric_experiment", "mde_ratio_metric", "split_search",
    "counterfactual_effect", "correlation_spearman", "false_positive_rate",
]


def main() -> None:
    from pyspark.sql import SparkSession

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("cohorta-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cohorta-bench-"))
    from cohorta.plans import QUERIES

    wanted = sys.argv[1:] or HEADLINE
    # Start the JVM's code paths and the Python workers before the clock runs.
    for name in ("count_if", "ab_test_single_metric"):
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in wanted:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
