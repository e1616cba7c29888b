"""One hunt cycle: search results in, new leads, visited URLs and graph out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.config import HuntConfig
from leadloom.operators.graph import graph_edges, graph_nodes
from leadloom.operators.leads import build_leads, new_store_rows
from leadloom.operators.search import search_topn
from leadloom.plans.crawl import CrawlResult, Step, crawl, opened_visits, settle_with_release


@dataclass(frozen=True)
class HuntCycle:
    """Results of a cycle, ready to append to the stores and the outreach queue."""

    crawl: CrawlResult
    queue: DataFrame
    new_leads: DataFrame
    new_visited: DataFrame
    nodes: DataFrame
    edges: DataFrame


def run_cycle(results: DataFrame, pages: DataFrame, store: DataFrame, verdicts: DataFrame, observe: Step,
              evaluate: Step, at: Column, visited: DataFrame | None = None,
              config: HuntConfig = HuntConfig()) -> HuntCycle:
    """results: query, query_order, position, href. Queries run in query_order, hits in hit order."""
    order = results.groupBy("query").agg(F.min("query_order").alias("query_order"))
    hits = search_topn(results, config.num_results, config).join(order, "query")
    root_order = F.col("query_order").cast("bigint") * config.num_results + F.col("hit_rank") - 1
    done = crawl(hits.select(root_order.alias("root_order"), "query", "href"), pages, observe, evaluate, visited, config)
    done, outcome = settle_with_release(done, pages, observe, evaluate, store, verdicts, visited)
    found = outcome.leads
    rows = found.select("email", F.col("company").alias("company_name"), F.col("person").alias("founder_name"),
                        F.col("summary").alias("reason"), at.alias("date_found"), "root_order")
    nodes = graph_nodes(outcome.events)
    return HuntCycle(
        crawl=done, queue=build_leads(found), new_leads=new_store_rows(rows, store, ["root_order"]),
        new_visited=opened_visits(done, found).select("url_hash", "url", at.alias("visited_at")),
        nodes=nodes, edges=graph_edges(outcome.events, nodes))
