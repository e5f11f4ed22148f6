"""Times the headline queries; prints one JSON line. $BENCH_SF_DIR and $BENCH_CPUS choose the tables and the cores."""

import json
import os
import time

from pyspark.sql import SparkSession

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
NAMES = [
    "ob12_binary", "ob19_lambdarank", "me13_auc", "me21_ndcg", "bn03_many_values", "bn12_binned_table", "tr01_histogram", "tr02_batch_histogram", "tr09_best_split",
    "sm05_goss_top", "pr04_raw_score", "pr04_raw_score_batches", "pr08_contributions", "bo01_regression", "bo01_binary", "tr26_leaf_wise",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from thicket import registry

    queries, took = registry.queries(), {}
    queries["tr06_leaf_totals"](spark, SF_DIR).count()  # the session's first query pays for its start
    for name in NAMES:
        began = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
