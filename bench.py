"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query writes its whole result to the noop sink, so nothing is pruned. One run to warm up the
JVM, then the median of $BENCH_RUNS runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.all_queries import QUERIES  # noqa: E402
from entitylake.session import local_session  # noqa: E402

HEADLINE = [
    "page_meta", "page_links", "page_emails", "page_technologies", "page_schema_org", "company_entities",
    "best_company_per_domain", "outlink_domains", "about_page_people", "service_terms", "text_people",
    "description_industry", "key_phrases", "query_analysis", "entity_validation", "relevancy_filter",
    "entity_rank", "candidate_urls", "rerun_new_entities", "query_entity_upsert", "entity_changes",
    "entity_detail_topn", "similar_entities", "crawl_stats", "stream_job_sessions", "discovery_run", "competitor_run",
]


def timed(spark, query, folder) -> float:
    started = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, partitions=max(cpus, 8), memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    result = {}
    for name in wanted:
        timed(spark, QUERIES[name], folder)
        result[name] = round(statistics.median(timed(spark, QUERIES[name], folder) for _ in range(runs)), 3)
        print(f"{name} {result[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "headline query seconds, summed", "value": round(sum(result.values()), 3), "unit": "sec",
        "queries": result, "sf": folder.rstrip("/").split("sf")[-1], "cpus": cpus, "runs": runs,
    }
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
