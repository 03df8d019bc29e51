"""Headline queries on one machine: prints one JSON line.

Each query runs once to warm up and then BENCH_REPEAT times; the best time counts. Results go
to a sink that computes every row and keeps none.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

HEADLINE = [
    "dataset_listing",
    "format_classifier",
    "tag_mapping",
    "normalised_messages",
    "normalised_records",
    "sample_cap",
    "json_array_records",
    "download_vote",
    "dataset_targets",
    "model_listing",
    "templates",
    "tokenizer_audit",
    "adapters_by_base",
    "model_search",
    "parsed_metrics",
    "running_steps",
    "patience",
    "best_loss",
    "best_checkpoint",
    "latest_metrics",
    "log_tail",
    "log_scan",
    "json_fallback",
    "live_monitor",
    "visible_turns",
    "visible_answers",
    "transcripts",
    "chat_sessions",
    "prompt_contexts",
    "run_configs",
    "config_overlay",
    "config_diff",
    "latest_runs",
    "run_summary",
    "directory_usage",
    "download_totals",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tunelake-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tunelake-bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from tunelake import plans
    from tunelake.plans.named import QUERIES

    plans.load_all()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        best = None
        for attempt in range(repeat + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if attempt and (best is None or took < best):
                best = took
        times[name] = round(best if best is not None else took, 4)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
