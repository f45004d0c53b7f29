"""Wall time of the headline queries; prints one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times; the median counts. A run
writes every row and column to the ``noop`` sink, so nothing is pruned away.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from harness import catalog

HEADLINE = [
    "kpi", "top_skills", "level_distribution", "top_companies", "category_salaries",
    "salary_by_experience", "treemap", "top_locations_share", "word_counts", "latest_jobs",
    "filter_options", "salary_normalize", "date_parse", "html_strip", "normalize_text",
    "flatten_docs", "bridge_rows", "surrogate_keys", "dedupe_latest", "insert_if_absent",
    "partial_upsert", "wide_rows", "chunk_text", "embed_text", "cosine_topk", "lexical_score",
    "avg_tie_rank", "hybrid_search", "last_turns", "prompt_messages", "dq_report",
    "session_activity", "dashboard_json", "incremental_load", "extract_load", "prompt_table",
    "rag_context",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = catalog.queries()
    seconds: dict[str, float] = {}
    for name in chosen:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(name, [round(t, 2) for t in taken], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
