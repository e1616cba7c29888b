"""Time the headline queries: one JSON line on stdout.

Every query runs once to warm up and then BENCH_REPEAT times (default 1); the
median counts. Results go to a noop sink, so all columns are computed and
nothing is collected. ``BENCH_QUERIES`` picks queries by name.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from leadloom.catalog import load
from leadloom.session import build_session

HEADLINE = (
    "url_normalize", "url_rank", "host_blocklist", "html_text", "link_markdown", "page_links", "top_links",
    "page_emails", "language_guard", "page_observation", "prompt_build", "decision_parse", "evaluate_rules",
    "lead_enrichment_flag", "lead_not_contacted", "lead_insert_ignore", "lead_status_update", "hunt_stats",
    "campaign_queries", "campaign_query_check", "search_topn", "hits_to_pages", "corpus_search",
    "send_schedule", "delivery_outcome", "fallback_leads", "state_changes", "decision_accuracy",
    "crawl_frontier", "crawl_min_depth", "node_events", "graph_nodes", "graph_edges",
    "stream_url_dedup", "stream_lead_sink", "stream_delivery_state", "stream_graph_nodes",
)


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    load()[name].build(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    chosen = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus), spark__ui__enabled="false",
                          spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("OFF")
    times = {}
    for name in chosen:
        run(spark, name, folder)
        times[name] = round(statistics.median(run(spark, name, folder) for _ in range(repeat)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
