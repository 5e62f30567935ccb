"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chunkloom.plans import catalog
from chunkloom.session import build_session

HEADLINE = """chunk_documents normalize_document_text estimate_tokens decode_text document_metadata duplicate_upload
documents_left_join_chunks replace_document_chunks vector_topk two_phase_topk rerank_score retrieval_eval metrics_at_k_grid
renumber_ranks build_prompts messages_with_citations recent_history build_chat_messages latest_task_state filter_tasks_by_entity
latency_summary token_cost_totals monitor_overview load_test_report concurrent_sessions rate_limit_fixed_window
stream_metrics_tumbling stream_reassemble read_sse_capture strip_think_tags embed_chunks ready_latency""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    catalog.load()
    spark = build_session(
        master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
