"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from gridleaf.plans.queries import QUERIES
from gridleaf.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
SMALL = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")

HEADLINE = [
    "invoice_totals", "blocks_to_grid", "reading_order", "dedupe_overlap", "merge_fragments", "image_to_table", "parse_cell",
    "compare_grids", "plan_tiles", "doc_info", "merge_docs", "page_text_rebuild", "extract_pages", "stamp_plan", "language_hint",
    "structure_lines", "resolve_names", "job_rollup", "first_success", "upsert_tasks", "cache_lookup", "cache_evict", "throttle",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        run(spark, name, SMALL)  # class loading and code generation
        seconds[name] = round(run(spark, name, FOLDER), 3)
    scale = os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale)}))
    spark.stop()


if __name__ == "__main__":
    main()
