"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from veriloom import session
from veriloom.plans import catalog

HEADLINE = [
    "rule_outcome_counts", "validation_results_long", "duplicate_property_ids", "duplicate_texts", "auto_decision",
    "record_detail_counts", "registry_search", "registry_page", "status_breakdown", "confidence_bands", "throughput",
    "dashboard_stats", "corrections_history", "review_history", "queue_neighbours", "select_reading", "detect_script",
    "read_confidence_proxy", "extract_fields", "strip_markup", "transliteration_guard", "gap_fill_and_confidence",
    "model_json_fields", "cer_by_engine", "field_accuracy", "similar_topk", "property_match", "apply_reviews",
    "correction_audit", "reupload_gate", "replace_children", "process_documents",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build(
        "bench", f"local[{cpus}]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - started, 3)
    found = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": float(found.group(1)) if found else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
