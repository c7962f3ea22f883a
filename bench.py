"""Times the headline queries: one JSON line, a warm run of each after a first one."""

from __future__ import annotations

import json
import os
import time


def main() -> None:
    from pyspark.sql import SparkSession

    from aerotrace.plans import catalogue

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        # columns are made without a record of the line of code each comes from
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # windows cost far more time than bytes: small partitions are not merged
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = ["q_resample_interp", "q_window_features", "q_label_distribution", "q_pairs", "q_pair_features", "q_outcome_score", "q_log_roundtrip", "q_annotation_lines", "q_manual_edits", "q_regression_metrics"]
    found = {n: catalogue.QUERIES[n] for n in names}
    took = {}
    for name, query in found.items():
        for _ in range(2):
            began = time.perf_counter()
            query(spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries, warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
