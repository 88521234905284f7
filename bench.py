"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from clausemesh.catalog import QUERIES  # noqa: E402
from clausemesh.session import get_session  # noqa: E402

HEADLINE = [
    "interval_solve", "solve_status", "solve_trace", "constraint_dedup", "soft_fallback", "spec_constraints", "brand_solve",
    "chunk_documents", "cosine_topk", "sparse_dot", "bm25_topk", "hybrid_retrieve", "rrf_duplicates", "retry_scan", "replay_gate",
    "question_constraints", "hybrid_vector_topk", "triage_failures", "audit_required", "trace_summary", "latency_nearest", "histogram_buckets", "quota_flags", "ingest_outcomes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    first: dict[str, float] = {}
    for name in HEADLINE:
        for into in (first, seconds):  # the first run compiles code and starts Python workers
            start = time.perf_counter()
            run(QUERIES[name](spark, sf_dir))
            into[name] = round(time.perf_counter() - start, 3)
    n = QUERIES["chunk_documents"](spark, sf_dir).count()
    rate = n / seconds["chunk_documents"]
    chars = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text)) AS n").first()["n"]
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "chunks_per_second": round(rate, 1),
                "chunk_characters_per_second": round(chars / seconds["chunk_documents"]), "first_run": first,
            }
        )
    )


if __name__ == "__main__":
    main()
