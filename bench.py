"""Time the headline queries and print one JSON line.

Each query runs once to warm up (class loading, code generation, Python workers) and once
for the measurement. Results go to Spark's no-op sink, so every row is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from kinmatch.plans.queries import QUERIES

HEADLINE = [
    "vector_topk",
    "vector_knn_batch",
    "extract_keywords",
    "matched_keywords",
    "keyword_search",
    "keyword_search_documents",
    "embed_texts",
    "embed_store_extend",
    "recommend_vector",
    "recommend_keyword",
    "recommend_routed",
    "upsert_changes",
    "upsert_merged",
    "upsert_repeated_keys",
    "record_stats",
    "context_window",
]


def run(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        run(spark, name, folder)
        times[name] = round(run(spark, name, folder), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall-clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
