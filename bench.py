"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from skysift.plans import queries as registered  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = (
    "results_table", "numeric_distributions", "correlation_pairs", "best_disposition", "vetting_summary",
    "schema_missing", "iqr_outliers", "duplicates_summary", "class_imbalance", "value_counts", "histogram",
    "results_summary", "catalogue_summary", "dedupe_keep_first", "target_prepare", "target_semi",
    "lc_dv_targets", "script_parse", "page_links", "free_text_ids", "catalog_text", "stratified_split",
    "exact_sample", "class_report", "lightcurve_summary", "lightcurve_decode", "quantile_scans", "correlation_wide",
    "duplicates_sample", "train_predict",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registered.queries(), {}
    for name in HEADLINE:
        times = []
        # The first run warms up; models take long enough to need no repetition.
        for _ in range(2 if name == "train_predict" else RUNS + 1):
            start = time.perf_counter()
            queries[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": FOLDER}))


if __name__ == "__main__":
    main()
