"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import time

from caselake.plans import registry
from caselake.session import get_session

HEADLINE = (
    "category_priority_pivot", "sla_buckets", "register_sort_priority", "search_folded", "net_corrections_topk", "repeat_counts", "recent_per_key", "trailing_run", "gaps_islands_days",
    "dedup_exact_text", "vector_topk", "jaccard_align", "protected_tokens", "classify_scores", "page_line_numbers", "history_budget", "html_lines", "events_session_batch",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline queries, sum of the better of 2", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
