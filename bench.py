"""Headline queries at one scale factor; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs twice in one session and counts with its faster run, so that compiling generated
code is not part of the figure.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import tablewarden as tw  # noqa: E402
from registry.queries import queries  # noqa: E402
from registry.views import DOCUMENTS, EVENTS, LINEITEM, ORDERS, PAGES, Audited  # noqa: E402

HEADLINE = (
    "null_counts_events",
    "distinct_counts_lineitem",
    "profile_numeric",
    "top_values_lineitem",
    "top_values_documents",
    "histogram_lineitem",
    "iqr_fences_lineitem",
    "medians",
    "outlier_rows",
    "duplicate_count_lineitem",
    "duplicate_rows",
    "duplicate_rows_documents",
    "drop_duplicates",
    "anomaly_date",
    "row_index",
    "csv_round_trip",
)


def audited(table: Audited):
    return lambda spark, sf_dir: finish(tw.audit(table.spark(spark, sf_dir), table.row_id).issues)


def repaired(table: Audited):
    return lambda spark, sf_dir: finish(tw.repair(table.spark(spark, sf_dir), table.row_id).cleaned)


def finish(df: DataFrame) -> None:
    """Compute the whole result without moving it to the driver."""
    df.write.format("noop").mode("overwrite").save()


def registered(name: str):
    return lambda spark, sf_dir: finish(queries()[name](spark, sf_dir))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablewarden-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tablewarden-bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {name: registered(name) for name in HEADLINE}
    runs["audit_lineitem"] = audited(LINEITEM)
    runs["audit_orders"] = audited(ORDERS)
    runs["audit_documents"] = audited(DOCUMENTS)
    runs["audit_messy_events"] = audited(EVENTS)
    runs["audit_pages"] = audited(PAGES)
    runs["repair_messy_events"] = repaired(EVENTS)
    runs["change_log_messy_events"] = lambda spark, sf_dir: finish(tw.repair(EVENTS.spark(spark, sf_dir), EVENTS.row_id).change_log)
    seconds = {}
    for name, run in runs.items():
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            run(spark, sf_dir)
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
        print(f"{name}: {seconds[name]}s", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "audit_and_repair_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )


if __name__ == "__main__":
    main()
