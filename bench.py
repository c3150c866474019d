"""Headline queries at one scale; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

HEADLINE = [
    "normalize_date",
    "classify_route",
    "extract_core_fields",
    "extract_sections_stacked",
    "goods_lines_text",
    "goods_lines_blocks",
    "document_remarks",
    "three_level_check",
    "reading_order_lines",
    "column_blocks",
    "tag_join",
    "tag_goods_lines",
    "business_dedup",
    "outcome_stats",
    "archive_roundtrip",
    "job_status",
]


def session(cpus: str):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(4 * int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    from billweave.plans.catalog import QUERIES

    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)

    def rows(name: str) -> int:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet").count()

    orders, documents = rows("orders"), rows("documents")
    print(json.dumps({
        "metric": "headline_total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "documents_per_second": {
            "extract_core_fields": round(orders / seconds["extract_core_fields"], 1),
            "document_remarks": round(orders / seconds["document_remarks"], 1),
            "reading_order_lines": round(documents / seconds["reading_order_lines"], 1),
        },
    }))
    spark.stop()


if __name__ == "__main__":
    main()
