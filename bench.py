"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR chooses the data (default /root/testdata/sf0.1), BENCH_CPUS the local threads.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

HEADLINE: tuple[str, ...] = (
    "entry_review_queue", "b01_normalize_text", "b06_chunk_text", "c03_redact", "d01_rule_currency", "e02_best_candidate",
    "e15_result_envelope", "f01_calculated_fields", "g03_version_diff", "h03_apply_edits", "i07_suggestions", "j02_ops_metrics",
    "j17_log_summary", "k05_case_results", "l02_stream_log_counts",
)


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("docweft")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from workload import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    names = HEADLINE or tuple(QUERIES)
    seconds: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(4):  # one warm-up, then the median of three
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
