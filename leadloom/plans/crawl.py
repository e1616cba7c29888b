"""Bounded crawl over stored pages.

One round per depth. A round is a fixed set of joins and aggregations, its
result is written once to the shared scratch folder, and the next round reads
that table, so plans stay small and a lost executor repeats at most one round.

A URL belongs to the first root that reaches it at the lowest depth, ties
going to the smaller (root_order, order_path).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from leadloom.config import EVENT_TITLES, HuntConfig, PLACEHOLDER_MARKER, QUERY_NODE_PREFIX
from leadloom.functions.context import add_to_ledger, annotate_last, path_context
from leadloom.functions.decisions import route, summary_or_default
from leadloom.functions.urls import is_junk, rank_url, url_hash, with_normalized_url
from leadloom.operators import leads as L
from leadloom.operators.groups import connected_groups
from leadloom.session import discard, write_scratch
from leadloom.sources.buckets import BucketStore, matching, missing

Step = Callable[[DataFrame], DataFrame]

_PATH = ["root_order", "order_path"]
_FRONTIER = [*_PATH, "query", "depth", "url", "parent_id", "ledger", "ancestors"]
_SEQ_ROUND, _SEQ_PENDING, _SEQ_SKIP, _SEQ_JUNK, _SEQ_BLANK, _SEQ_DECIDED = 100, 10, 20, 30, 40, 50


@dataclass(frozen=True)
class CrawlResult:
    """Tables of a finished crawl.

    frontier: every attempt to open a URL, with ``fresh`` telling first visits.
    visits: first visits with outcome and decision.
    """

    frontier: DataFrame
    visits: DataFrame
    config: HuntConfig


@dataclass(frozen=True)
class HuntOutcome:
    leads: DataFrame
    branches: DataFrame
    events: DataFrame


def root_frontier(hits: DataFrame) -> DataFrame:
    """Hits (root_order, query, href) as the depth-0 frontier. A hit that is no usable URL is tried as the empty one."""
    roots = with_normalized_url(hits, "href", "href", "url").withColumn("url", F.coalesce("url", F.lit("")))
    no_strings = F.array().cast("array<string>")
    return roots.select(
        F.col("root_order").cast("bigint").alias("root_order"), "query",
        F.array().cast("array<int>").alias("order_path"), F.lit(0).alias("depth"), "url",
        F.concat(F.lit(QUERY_NODE_PREFIX), F.col("query")).alias("parent_id"), no_strings.alias("ledger"),
        no_strings.alias("ancestors"))


def _first_visits(frontier: DataFrame, seen: list[DataFrame], visited: DataFrame | BucketStore | None) -> DataFrame:
    rest = [c for c in frontier.columns if c not in ("url_hash", *_PATH)]
    packed = frontier.groupBy("url_hash").agg(F.min(F.struct(*_PATH, *rest)).alias("r"))
    fresh = packed.select("url_hash", "r.*")
    if seen:
        known = reduce(DataFrame.unionByName, [s.select("url_hash") for s in seen])
        fresh = fresh.join(known, "url_hash", "left_anti")
    if visited is None:
        return fresh
    # A bucket store is asked for the buckets of these URLs, so they are fixed first.
    return missing(visited, write_scratch(fresh, "fresh") if isinstance(visited, BucketStore) else fresh, "url_hash")


def _children(visits: DataFrame, config: HuntConfig) -> DataFrame:
    follow = visits.where("outcome = 'FOLLOW'").withColumn(
        "noted", annotate_last(F.col("ledger"), F.col("summary")))
    targets = follow.select(
        *_PATH, "query", F.col("depth") + 1, F.col("url").alias("parent_id"), F.col("noted").alias("ledger"),
        F.array_append("ancestors", F.col("url")).alias("ancestors"), F.explode("targets").alias("target"))
    targets = targets.toDF(*_PATH, "query", "depth", "parent_id", "ledger", "ancestors", "target").where("target != ''")
    # What is no usable URL becomes the empty one; it is tried like any other and found on no page.
    targets = with_normalized_url(targets, "parent_id", "target", "url").drop("target").withColumn(
        "url", F.coalesce("url", F.lit("")))
    targets = targets.withColumn("rank", rank_url(F.col("url"), config.high_value_words, config.low_value_words))
    # dense_rank counts distinct URLs, so repeats are dropped after the cut.
    best = Window.partitionBy("parent_id").orderBy("rank", "url")
    kept = targets.withColumn("leaf", F.dense_rank().over(best)).where(F.col("leaf") <= config.max_leafs)
    return kept.dropDuplicates(["parent_id", "leaf"]).withColumn(
        "order_path", F.array_append("order_path", F.col("leaf"))).drop("rank", "leaf")


def _decide(opened: DataFrame, observe: Step, evaluate: Step, config: HuntConfig) -> DataFrame:
    """Outcome and decision of pages that were found, by url_hash."""
    seen = observe(opened)
    seen = seen.withColumns({
        "blank": F.coalesce(F.trim("text"), F.lit("")) == "",
        "context": path_context(F.col("ledger"), config.max_path_chars)})
    decision = lambda name: F.col(f"decision.{name}").alias(name)
    return evaluate(seen).select(
        "url_hash", *_PATH, "query", "depth", "url", "ledger", "ancestors",
        F.when(F.col("blank"), "blank").otherwise(route(F.col("decision.decision"))).alias("outcome"),
        summary_or_default(F.col("decision.discovery_summary")).alias("summary"),
        F.col("decision.next_target_urls").alias("targets"), decision("company"), decision("person"), decision("email"))


def crawl(hits: DataFrame | None, pages: DataFrame | BucketStore, observe: Step, evaluate: Step,
          visited: DataFrame | BucketStore | None = None, config: HuntConfig = HuntConfig(),
          resume: DataFrame | None = None, known: DataFrame | None = None) -> CrawlResult:
    """Follow links from ``hits`` down to ``config.max_depth``.

    known: further ``url_hash`` values that count as visited.
    resume: attempts (rows of an earlier ``frontier``) that join the rounds of
    their depth, with or without ``hits``.

    pages: ``url`` (normalised, unique) and what ``observe`` needs, as a table or
    a bucket store by ``url``; visited: ``url_hash``, as a table or a bucket
    store. Of a bucket store a round reads the buckets of its URLs only.
    observe: adds ``text`` (blank if unusable) to joined pages.
    evaluate: adds ``decision``; it also sees ``context``, the path so far.

    Junk and visited URLs leave before the page join, and ``observe`` runs
    after it, so only pages that are really opened are parsed. The join is an
    inner one against a written table of known size: while a round is small,
    Spark sends its URLs to the pages and shuffles no page.
    """
    seen = [known.select("url_hash")] if known is not None else []
    attempts, firsts, decisions = [], [], []
    for depth in range(config.max_depth + 2):
        sources = [_children(decisions[-1], config)] if depth else [root_frontier(hits)] if hits is not None else []
        if resume is not None:
            waiting = resume.where(F.col("depth") == depth)
            sources.append(waiting.select(*(sources[0].columns if sources else _FRONTIER)))
        frontier = reduce(DataFrame.unionByName, sources).withColumn("url_hash", url_hash(F.col("url")))
        attempts.append(frontier)
        if depth > config.max_depth:
            break
        first = _first_visits(frontier, seen, visited).withColumns({
            "ledger": add_to_ledger(F.col("ledger"), F.col("depth"), F.col("url")),
            "junk": is_junk(F.col("url"), config.junk_domains)})
        first = write_scratch(first, "first-visits")
        if depth > 0 and resume is None and first.isEmpty():
            break
        seen.append(first)
        firsts.append(first)
        opened = matching(pages, first.where(~F.col("junk")).drop("junk"), "url")
        decisions.append(write_scratch(_decide(opened, observe, evaluate, config), "decisions"))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    decided = union(decisions).select("url_hash", "outcome", "summary", "targets", "company", "person", "email")
    every = union(firsts)
    visits = every.join(decided, "url_hash", "left").withColumn("outcome", F.coalesce(
        "outcome", F.when(F.col("junk"), "junk").otherwise("blank"))).drop("junk")
    owners = every.select(*_PATH, F.lit(True).alias("fresh"))
    tried = union(attempts).join(owners, _PATH, "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    return CrawlResult(write_scratch(tried, "frontier"), write_scratch(visits, "visits"), config)


def first_lead_per_root(candidates: DataFrame) -> DataFrame:
    """The first candidate (smallest order_path) of each root."""
    rest = [c for c in candidates.columns if c not in _PATH]
    return candidates.groupBy("root_order").agg(F.min(F.struct("order_path", *rest)).alias("r")).select(
        "root_order", "r.*")


def _one_after_another(rows: pd.DataFrame) -> pd.DataFrame:
    """The choices of some roots, earlier ones first; rows: root_order, order_path, email."""
    taken: set[str] = set()
    chosen = []
    ordered = sorted(zip(rows.root_order, map(tuple, rows.order_path), rows.email))
    for root, own in groupby(ordered, key=lambda r: r[0]):
        for _, path, email in own:
            if PLACEHOLDER_MARKER in email or email not in taken:
                taken.add(email)
                chosen.append((root, list(path)))
                break
    return pd.DataFrame(chosen, columns=_PATH)


def _disputed(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(choices, rest) of roots that compete: connected groups of up to ``most`` rows are settled in one task each."""
    if rows.count() <= most:
        sized = rows.withColumn("group", F.lit(0))
        small, rest = sized, rows.where("false")
    else:
        links = rows.select(F.xxhash64(F.lit("root"), F.col("root_order").cast("string")).alias("a"), F.xxhash64("email").alias("b"))
        groups = connected_groups(links)
        placed = rows.join(groups, F.xxhash64(F.lit("root"), F.col("root_order").cast("string")) == F.col("node")).drop("node")
        sizes = placed.groupBy("group").agg(F.count("*").alias("n"))
        sized = write_scratch(placed.join(sizes, "group"), "disputes")
        small, rest = sized.where(F.col("n") <= most), sized.where(F.col("n") > most).select(*rows.columns)
    chosen = small.select("group", *_PATH, "email").groupBy("group").applyInPandas(
        lambda part: _one_after_another(part), "root_order long, order_path array<int>")
    return chosen, rest


def settle_leads(candidates: DataFrame, most: int = 100_000) -> DataFrame:
    """One lead per root and one root per e-mail, earlier roots choosing first.

    The result is that of handling the roots one after another. A choice is
    certain if no earlier root has the same e-mail among its candidates, or if
    it is a placeholder, which may repeat; what a root has behind its first
    certain choice doesn't matter. Roots whose first choice is certain are done,
    and their e-mails go from all others. What is left are chains of refusals:
    they are cut into groups of roots that share e-mails, and a group of up to
    ``most`` rows is settled in order by one task. Larger groups go through the
    loop again, which makes them smaller every time. So a chain of refusals
    costs no round per link.
    """
    rows = write_scratch(candidates, "candidates")
    left = rows.select(*_PATH, "email")
    done: list[DataFrame] = []
    real = ~F.col("email").contains(PLACEHOLDER_MARKER)
    while True:
        # Placeholders never compete; left in, all of them would meet on one key.
        holders = left.where(real).groupBy("email").agg(F.min("root_order").alias("holder"))
        marked = left.where(real).join(holders, "email").withColumn("certain", F.col("root_order") == F.col("holder")).drop("holder")
        marked = write_scratch(marked.select(*_PATH, "email", "certain").unionByName(
            left.where(~real).withColumn("certain", F.lit(True))), "marked")
        firsts = marked.groupBy("root_order").agg(
            F.min(F.struct("order_path", "email", "certain")).alias("first"), F.min(F.when(F.col("certain"), F.col("order_path"))).alias("last"))
        firsts = write_scratch(firsts, "firsts")
        done.append(firsts.where("first.certain").select("root_order", F.col("first.order_path").alias("order_path")))
        taken = firsts.where("first.certain").select("first.email").where(real)
        waiting = firsts.where("NOT first.certain").select("root_order", "last")
        rest = marked.join(waiting, "root_order").where(F.col("last").isNull() | (F.col("order_path") <= F.col("last"))).select(*_PATH, "email")
        rest = write_scratch(rest.where(real).join(taken, "email", "left_anti").select(*_PATH, "email").unionByName(rest.where(~real)), "rest")
        discard(marked)
        if rest.isEmpty():
            break
        chosen, left = _disputed(rest, most)
        done.append(write_scratch(chosen, "settled"))
        left = write_scratch(left, "large")
        if left.isEmpty():
            break
    return rows.join(reduce(DataFrame.unionByName, done), _PATH, "left_semi")


def converted_leads(result: CrawlResult, verdicts: DataFrame, verification: bool = True) -> DataFrame:
    """CONVERT pages as cleaned leads; an unusable address becomes a placeholder."""
    converted = result.visits.where("outcome = 'CONVERT'").select(
        *_PATH, "depth", "query", "url", "ancestors", "summary", "company", "person", "email")
    judged = L.with_deliverability(L.clean_lead(converted), verdicts, verification)
    return L.flag_for_enrichment(judged).drop("verdict", "deliverable")


def branch_rollup(result: CrawlResult, leads: DataFrame) -> DataFrame:
    """A FOLLOW page is ``convert`` if any page below it gave a lead, else ``prune``."""
    paid_off = leads.select(F.explode("ancestors").alias("url")).groupBy("url").agg(
        F.count("*").alias("n_leads"))
    follow = result.visits.where("outcome = 'FOLLOW'").select("url", "depth", "summary", "parent_id", "targets")
    return follow.join(paid_off, "url", "left").select(
        "url", "depth", "summary", F.coalesce("n_leads", F.lit(0)).cast("bigint").alias("n_leads"),
        F.when(F.col("n_leads") > 0, "convert").otherwise("prune").alias("state"),
        (F.size("targets") > 0).alias("has_targets"))


def node_events(result: CrawlResult, converted: DataFrame, leads: DataFrame, branches: DataFrame) -> DataFrame:
    """All node updates of a crawl: seq, node_id, state, title, parent_id.

    A converted page that comes before the lead of its root (or whose root has
    none) was refused because its e-mail is taken. One that comes after it lies
    beyond the early exit and stays pending.
    """
    frontier, visits = result.frontier, result.visits
    nothing = F.lit(None).cast("string")

    def event(df, step, state, title, parent=nothing, node=F.col("url")):
        seq = (F.col("depth") * _SEQ_ROUND + step).cast("bigint")
        return df.select(seq.alias("seq"), node.alias("node_id"), F.lit(state).alias("state"),
                         title.alias("title"), parent.alias("parent_id"))

    chosen = leads.select("root_order", F.col("order_path").alias("chosen_path"))
    refused = converted.join(chosen, "root_order", "left").where(
        F.col("chosen_path").isNull() | (F.col("order_path") < F.col("chosen_path")))
    last = (result.config.max_depth + 2) * _SEQ_ROUND
    queries = frontier.where("depth = 0").select("query").distinct()
    parts = [
        queries.select(F.lit(0).cast("bigint").alias("seq"), F.concat(F.lit(QUERY_NODE_PREFIX), "query").alias("node_id"),
                       F.lit("query").alias("state"), F.lit(EVENT_TITLES["query"]).alias("title"),
                       nothing.alias("parent_id")),
        event(frontier, _SEQ_PENDING, "pending", F.concat(F.lit(EVENT_TITLES["pending"]), F.col("depth").cast("string")),
              F.col("parent_id")),
        event(frontier.where(~F.col("fresh")), _SEQ_SKIP, "skip", F.lit(EVENT_TITLES["skipped"])),
        event(visits.where("outcome = 'junk'"), _SEQ_JUNK, "prune", F.lit(EVENT_TITLES["junk"])),
        event(visits.where("outcome = 'blank'"), _SEQ_BLANK, "prune", F.lit(EVENT_TITLES["blank"])),
        event(visits.where("outcome = 'PRUNE'"), _SEQ_DECIDED, "prune",
              F.concat(F.lit(EVENT_TITLES["pruned"]), F.col("summary"))),
        event(branches.where(~F.col("has_targets")), _SEQ_DECIDED, "skip", F.lit(EVENT_TITLES["no_links"])),
        event(refused, _SEQ_DECIDED, "skip", F.lit(EVENT_TITLES["refused"])),
        event(leads, _SEQ_DECIDED, "convert", F.concat(F.lit(EVENT_TITLES["lead"]), F.col("company"))),
        branches.where("has_targets").select(
            (F.lit(last) + result.config.max_depth - F.col("depth")).cast("bigint").alias("seq"),
            F.col("url").alias("node_id"), "state", F.concat(F.lit(EVENT_TITLES["branch"]), F.col("summary")).alias("title"),
            nothing.alias("parent_id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def settle(result: CrawlResult, store: DataFrame, verdicts: DataFrame, verification: bool = True) -> HuntOutcome:
    """Leads, branch results and node events of a crawl."""
    converted = write_scratch(converted_leads(result, verdicts, verification), "converted")
    leads = settle_leads(L.not_yet_stored(converted, store))
    branches = branch_rollup(result, leads)
    return HuntOutcome(leads, branches, node_events(result, converted, leads, branches))


def _beyond_exit(visits: DataFrame, leads: DataFrame) -> DataFrame:
    """Visits that a root would not have made, because its lead came before them."""
    chosen = leads.select("root_order", F.col("order_path").alias("chosen_path"))
    return visits.join(chosen, "root_order").where(F.col("order_path") > F.col("chosen_path")).drop("chosen_path")


def opened_visits(result: CrawlResult, leads: DataFrame) -> DataFrame:
    """Visits that count as made: all but those beyond their root's lead. These belong into the visited store."""
    return result.visits.join(_beyond_exit(result.visits, leads).select(*_PATH), _PATH, "left_anti")


def settle_with_release(result: CrawlResult, pages: DataFrame | BucketStore, observe: Step, evaluate: Step, store: DataFrame,
                        verdicts: DataFrame, visited: DataFrame | BucketStore | None = None,
                        verification: bool = True) -> tuple[CrawlResult, HuntOutcome]:
    """``settle``, with URLs beyond a root's lead given to roots that were refused them.

    A root stops at its first lead, so what it would have opened later is free
    for other roots without a lead. Their refused attempts at free URLs start
    another crawl, until none is left. Every round opens at least one URL for
    good or ends with one root less without a lead.
    """
    def candidates(part: CrawlResult) -> DataFrame:
        return L.not_yet_stored(converted_leads(part, verdicts, verification), store)

    leads = write_scratch(settle_leads(candidates(result)), "leads")
    while True:
        free = _beyond_exit(result.visits, leads)
        waiting = result.frontier.where(~F.col("fresh")).join(free.select("url_hash"), "url_hash", "left_semi").join(
            leads.select("root_order"), "root_order", "left_anti")
        waiting = write_scratch(waiting, "waiting")
        if waiting.isEmpty():
            break
        kept = opened_visits(result, leads).select("url_hash")
        again = crawl(None, pages, observe, evaluate, visited, result.config, resume=waiting, known=kept)
        result = CrawlResult(
            write_scratch(result.frontier.join(waiting.select(*_PATH), _PATH, "left_anti").unionByName(again.frontier),
                          "frontier"),
            write_scratch(result.visits.join(again.visits.select("url_hash"), "url_hash", "left_anti").unionByName(
                again.visits), "visits"), result.config)
        more = candidates(again).join(leads.select("root_order"), "root_order", "left_anti")
        taken = leads.where(~F.col("email").contains(PLACEHOLDER_MARKER)).select("email")
        more = settle_leads(more.join(taken, "email", "left_anti"))
        leads = write_scratch(leads.unionByName(more.select(*leads.columns)), "leads")
    converted = write_scratch(converted_leads(result, verdicts, verification), "converted")
    branches = branch_rollup(result, leads)
    return result, HuntOutcome(leads, branches, node_events(result, converted, leads, branches))


def leads_per_query(result: CrawlResult, leads: DataFrame) -> DataFrame:
    """Leads found per query, queries without a lead included."""
    found = leads.groupBy("query").agg(F.count("*").alias("n_leads"))
    queries = result.frontier.where("depth = 0").groupBy("query").agg(F.count("*").alias("n_roots"))
    return queries.join(found, "query", "left").withColumn("n_leads", F.coalesce("n_leads", F.lit(0)).cast("bigint"))


def funnel_by_depth(result: CrawlResult) -> DataFrame:
    """Pages and outcomes per depth, with the share of converting pages."""
    counted = result.visits.groupBy("depth").agg(
        F.count("*").alias("n_pages"), F.count_if(F.col("outcome") == "CONVERT").alias("n_convert"),
        F.count_if(F.col("outcome") == "FOLLOW").alias("n_follow"),
        F.count_if(F.col("outcome").isin("junk", "blank", "PRUNE")).alias("n_prune"))
    return counted.withColumn("depth", F.col("depth").cast("bigint")).withColumn(
        "conversion_rate", F.round(F.col("n_convert") / F.col("n_pages"), 6))
