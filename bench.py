"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from lodestone import catalog
from lodestone.session import local_session

HEADLINE = (
    "normalize_text",
    "detect_language",
    "corpus_documents",
    "chunk_corpus",
    "chunk_statistics",
    "plan_index",
    "sync_index",
    "lexical_embedding",
    "similarity_join",
    "retrieval_report",
    "sweep",
    "lexical_retrieve",
    "pack_context",
    "parse_replies",
    "answer_decision",
    "score_answers",
    "call_summary",
    "forecast_run",
    "failure_streak",
    "projected_cost",
    "acceptance_verdict",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries = catalog.queries()
    # One small query first, so that session start-up is not charged to the first one.
    queries["estimate_tokens"](spark, folder).count()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
