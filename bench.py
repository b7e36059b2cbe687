"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query is timed to full materialisation (a no-op sink write), which
runs the whole plan without pulling rows to the driver.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabwright import plans  # noqa: E402
from tabwright.session import build_session  # noqa: E402

# One or two queries per operator family; BENCH_ALL=1 runs every registered query.
HEADLINE = [
    "stage_step_plan", "chat_rows_jsonl", "conversation_metadata_injection",        # M14-M16, A11, A12
    "column_types_lineitem", "column_enums", "primary_keys", "schema_constraints",  # A1, A2, A8-A10
    "header_schema_fields", "schema_ids",                                            # A3, A5, F3-F17
    "table_stage_rows", "schema_stage_rows", "prompt_rows_documents",               # M1-M13
    "statements_round_trip", "tables_round_trip", "ndjson_round_trip", "schema_block_round_trip",  # X1-X7
    "sanity_report", "statement_prf", "cell_f1", "loss_summary",                     # E1-E12
    "unroll_customer", "unroll_named_tables", "doc_statements", "record_violations",  # G4-G6, P1-P8
    "model_call_stub", "streaming_append", "jsonl_lenient", "compressed_text",       # G1, G7, S1-S4
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16)
    names = only or (list(plans.QUERIES) if os.environ.get("BENCH_ALL") == "1" else HEADLINE)
    times = {}
    # warm-up: JVM class loading and Python worker start, not charged to any query
    plans.QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for n in names:
        t0 = time.time()
        plans.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
