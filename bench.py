"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "g1_directly_follows", "g2_variants", "g3_footprint", "g4_heuristics", "g6_inductive_tree", "g19_rule_counts", "g20_skeleton", "g21_handover", "g27_busy_time",
    "f2_activity_stats", "f12_performance_spectrum", "f22_multiplicity", "f37_totem_cardinalities", "f38_ocdfg_edges", "b1_flatten", "b7_ablate", "c6_as_of", "h2_token_replay", "h18_structural",
]


def main() -> None:
    from pyspark.sql import SparkSession

    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tracewright.plans import all_queries

    queries, took = all_queries(), {}
    spark.range(1000).groupBy().count().collect()  # the session is up before the clock runs
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
