"""Headline queries, each once to warm up and then timed: one JSON line."""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402

from lodestrand.plans import inventory  # noqa: E402

HEADLINE = ("m1_m2_auroc_auprc", "m5_metrics_by_distance", "j3_star_join", "j10_overlap_join", "j14_window_counts", "j19_nearest", "a14_merge", "a31_co_occurrence", "w4_shrinking_mean", "w10_most_in_window", "m8_spearman", "m11_mann_whitney", "r1_pools")
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        for _ in range(2):  # the second run counts: the first compiles
            began = time.time()
            inventory.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
