"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from parlance.plans import registry

HEADLINE = ["q_window_count", "q_window_by_time", "q_episode_metrics", "q_join_dedup_left", "q_search_exact", "q_search_tf", "q_search_bm25", "q_kwic", "q_interval_label", "q_islands", "q_shared_guest_pairs", "q_ngram_reuse", "q_zscore", "q_show_rollup", "q_session"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):  # the first also compiles
            began = time.time()
            registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline queries, sum of seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
