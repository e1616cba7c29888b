"""The crawl over stored pages, and what follows from it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from leadloom.catalog import search, sql as S
from leadloom.catalog.leads import TOPIC
from leadloom.catalog.registry import query
from leadloom.catalog.web import JUNK
from leadloom.config import EMAIL_HEADER_PREFIX, EMAIL_HEADER_SUFFIX, HuntConfig
from leadloom.functions.patterns import any_of
from leadloom.functions.urls import with_normalized_url
from leadloom.operators import graph as G, leads as L, pages as P
from leadloom.operators.evaluate import evaluate_by_rules
from leadloom.catalog.search import HITS_SQL
from leadloom.plans import crawl as C
from leadloom.plans.hunt import run_cycle
from leadloom.session import discard, parallelism, scratch_path, write_scratch
from leadloom.sources.buckets import BucketStore, write_buckets
from leadloom.sources.tables import export_graph, import_graph, read_table

HIGH, LOW = (".net", ".org"), ("blog",)
CONFIG = HuntConfig(max_depth=3, max_leafs=4, junk_domains=JUNK, high_value_words=HIGH, low_value_words=LOW)
HOST = "^[a-z]+://([^/?#]*)"
SITE_BUCKETS = 32
PAIRS_PER_TASK = 250_000


def site(spark, sf):
    """Stored pages that link to each other, as a bucket store by URL.

    No stored page links to another one, so every page gets anchors to the
    pages at up to five related ids, and those of www and m hosts a mailto link.
    Of pages with one normalised URL the one with the smallest id stays.
    """
    pages = read_table(spark, sf, "pages")
    ids = pages.select("page_id", F.explode(F.expr(
        "array(2 * page_id + 1, 2 * page_id + 2, 3 * page_id + 1, page_id div 2, page_id + 7)")).alias("to_id")).distinct()
    named = ids.join(pages.select(F.col("page_id").alias("to_id"), F.col("url").alias("to_url")), "to_id")
    anchors = named.groupBy("page_id").agg(F.array_join(F.sort_array(F.collect_list(
        F.concat(F.lit('<p><a href="'), "to_url", F.lit('">see</a></p>')))), "").alias("anchors"))
    mail = F.when(F.col("url").rlike("//(?:www|m)[.]"), F.concat(
        F.lit('<a href="mailto:info@'), F.regexp_extract("url", HOST, 1), F.lit('">mail</a>'))).otherwise("")
    names = with_normalized_url(pages.select("page_id", "url"), "url", "url", "norm")
    first = names.groupBy("norm").agg(F.min("page_id").alias("page_id"))  # ids only; the pages themselves aren't sorted
    built = pages.join(first, "page_id").join(anchors, "page_id", "left").select(
        F.col("norm").alias("url"), "page_id", F.concat("html", F.coalesce("anchors", F.lit("")), mail).alias("html"))
    path = scratch_path(spark, "site")
    write_buckets(built, path, "url", SITE_BUCKETS)
    return BucketStore.open(spark, path, "url")


def roots(spark, sf):
    return read_table(spark, sf, "pages", ["page_id", "url"]).where(F.col("url").contains("?")).select(
        F.col("page_id").alias("root_order"), F.col("url").alias("href"),
        F.concat(F.lit("lang "), F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]+)/", 1)).alias("query"))


def observe(df):
    return P.observations(df.withColumn("html", F.coalesce("html", F.lit(""))), CONFIG)


def evaluate(df):
    return evaluate_by_rules(df, topic_words=TOPIC, off_topic_words=(), high=HIGH, low=LOW)


def stored_leads(spark, sf):
    return read_table(spark, sf, "pages", ["url"]).where(F.col("url").contains("/de/")).select(
        F.concat(F.lit("info@"), F.regexp_extract("url", HOST, 1)).alias("email")).distinct()


def verdicts(spark, sf):
    return read_table(spark, sf, "pages", ["url"]).where(F.col("url").contains("/fr/")).select(
        F.concat(F.lit("info@"), F.regexp_extract("url", HOST, 1)).alias("email"), F.lit("invalid").alias("result")).distinct()


def crawled(spark, sf):
    return C.crawl(roots(spark, sf), site(spark, sf), observe, evaluate, config=CONFIG)


def hunted(spark, sf):
    """Crawl and outcome of the stored pages."""
    result = crawled(spark, sf)
    return result, C.settle(result, stored_leads(spark, sf), verdicts(spark, sf))


# --- the same in SQL ----------------------------------------------------------

_NORM = "rtrim(regexp_replace({0}, '#.*', ''), '/')"
_SITE_SQL = f"""
ids AS (SELECT DISTINCT page_id, unnest([2 * page_id + 1, 2 * page_id + 2, 3 * page_id + 1, page_id // 2, page_id + 7]) AS to_id FROM pages),
anch AS (SELECT ids.page_id, string_agg('<p><a href="' || p.url || '">see</a></p>', '' ORDER BY '<p><a href="' || p.url || '">see</a></p>') AS a
         FROM ids JOIN pages p ON p.page_id = to_id GROUP BY ids.page_id),
built AS (SELECT p.page_id, {_NORM.format('url')} AS url, html || coalesce(a, '') || CASE WHEN regexp_matches(url, '//(?:www|m)[.]')
          THEN '<a href="mailto:info@' || regexp_extract(url, '{HOST}', 1) || '">mail</a>' ELSE '' END AS html
          FROM pages p LEFT JOIN anch ON anch.page_id = p.page_id),
site AS (SELECT page_id, url, html FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM built) WHERE rn = 1),
{S.markdown_ctes('site')},
guard AS ({S.language_cte('md', 'page_id', 'body')}),
seen AS (SELECT md.page_id, md.url, {S.clean_emails(S.emails('html'))} AS emails,
    trim(body) <> '' AND coalesce(language = 'en', true) AS usable, body FROM md JOIN guard ON md.page_id = guard.page_id),
texts AS (SELECT page_id, url, emails, usable, left(CASE WHEN len(emails) > 0 THEN {S.lit(EMAIL_HEADER_PREFIX)} || array_to_string(emails, ', ')
    || {S.lit(EMAIL_HEADER_SUFFIX)} || body ELSE body END, 16000) AS text FROM seen),
targets AS (SELECT page_id, list_sort(list_distinct(list(t))) AS targets FROM (SELECT page_id, {S.rooted_url('url', S.anchor_href('f'))} AS t FROM
    (SELECT page_id, url, unnest({S.anchors(S.remove_noise('html'))}[2:]) AS f FROM site) WHERE {S.anchor_href('f')} <> '')
    WHERE {S.matches('lower(t)', any_of(HIGH))} GROUP BY page_id),
decided AS (SELECT texts.url, usable, emails, coalesce(targets, CAST([] AS VARCHAR[])) AS targets,
    {S.matches('lower(text)', any_of(TOPIC))} AS topic FROM texts LEFT JOIN targets ON texts.page_id = targets.page_id),
verdict AS (SELECT url, CASE WHEN NOT usable THEN 'blank' WHEN NOT topic THEN 'PRUNE' WHEN len(emails) > 0 THEN 'CONVERT'
    WHEN len(targets) > 0 THEN 'FOLLOW' ELSE 'PRUNE' END AS outcome, emails[1] AS email, targets,
    CASE WHEN NOT topic THEN 'no topic match' WHEN len(emails) > 0 THEN 'topic match with e-mail'
    WHEN len(targets) > 0 THEN 'topic match, contact link visible' ELSE 'topic match without contact' END AS summary FROM decided),
"""


def _rounds_sql(depth_limit: int, leafs: int, roots_sql: str) -> str:
    parts = [f"""f0 AS (SELECT root_order, query, CAST([] AS INTEGER[]) AS order_path, 0 AS depth, {_NORM.format('href')} AS url,
        'QUERY: ' || query AS parent_id, CAST([] AS VARCHAR[]) AS ledger, CAST([] AS VARCHAR[]) AS ancestors FROM ({roots_sql}))"""]
    for d in range(depth_limit + 1):
        old = "".join(f" AND url NOT IN (SELECT url FROM v{i})" for i in range(d))
        parts.append(f"""v{d} AS (SELECT o.* EXCLUDE (rn) REPLACE (list_append(ledger, '[{d}] ' || o.url) AS ledger),
            CASE WHEN {S.matches('lower(o.url)', any_of(JUNK))} THEN 'junk' ELSE coalesce(outcome, 'blank') END AS outcome, email, targets, summary
            FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY root_order, order_path) AS rn FROM f{d} WHERE true{old}) o
            LEFT JOIN verdict ON verdict.url = o.url WHERE rn = 1)""")
        parts.append(f"""f{d + 1} AS (SELECT root_order, query, list_append(order_path, CAST(leaf AS INTEGER)) AS order_path, {d + 1} AS depth, t AS url,
            url AS parent_id, list_append(ledger[:-2], ledger[-1] || ' -> [Note: ' || summary || ']') AS ledger, list_append(ancestors, url) AS ancestors
            FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY t) AS leaf FROM (SELECT *, unnest(targets) AS t FROM v{d} WHERE outcome = 'FOLLOW'))
            WHERE leaf <= {leafs})""")
    parts.append("visits AS (" + " UNION ALL ".join(f"SELECT * FROM v{i}" for i in range(depth_limit + 1)) + ")")
    parts.append("frontier AS (" + " UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(depth_limit + 2)) + ")")
    return ",\n".join(parts)


_ROOTS_SQL = """SELECT page_id AS root_order, url AS href, 'lang ' || regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1) AS query
    FROM pages WHERE contains(url, '?')"""
_CRAWL_SQL = "WITH RECURSIVE " + _SITE_SQL.strip() + "\n" + _rounds_sql(3, 4, _ROOTS_SQL)
# Roots one after another; each takes its first candidate whose e-mail is free.
_SETTLE_SQL = f"""
stored AS (SELECT DISTINCT 'info@' || regexp_extract(url, '{HOST}', 1) AS email FROM pages WHERE contains(url, '/de/')),
refused AS (SELECT DISTINCT 'info@' || regexp_extract(url, '{HOST}', 1) AS email FROM pages WHERE contains(url, '/fr/')),
found AS (SELECT root_order, order_path, query, url, ancestors, 'Unknown' AS company,
    CASE WHEN email IN (SELECT email FROM refused) THEN 'NEEDS_ENRICHMENT@unknown.com' ELSE email END AS email FROM visits WHERE outcome = 'CONVERT'),
cand AS (SELECT *, dense_rank() OVER (ORDER BY root_order) AS turn FROM found WHERE email NOT IN (SELECT email FROM stored)),
turns AS (SELECT CAST(0 AS BIGINT) AS turn, CAST([] AS VARCHAR[]) AS taken, CAST([] AS INTEGER[]) AS path
  UNION ALL SELECT t.turn + 1, coalesce(list_append(t.taken, e), t.taken), p FROM turns t, LATERAL (
    SELECT arg_min(email, order_path) AS e, min(order_path) AS p FROM cand WHERE cand.turn = t.turn + 1
      AND (NOT list_contains(t.taken, email) OR contains(email, 'NEEDS_ENRICHMENT'))) WHERE t.turn < (SELECT max(turn) FROM cand)),
leads AS (SELECT cand.* FROM cand JOIN turns ON cand.turn = turns.turn AND cand.order_path = turns.path),
branches AS (SELECT v.url, v.depth, v.summary, count(l.url) AS n_leads FROM visits v LEFT JOIN
    (SELECT unnest(ancestors) AS url FROM leads) l ON l.url = v.url WHERE outcome = 'FOLLOW' GROUP BY v.url, v.depth, v.summary)"""
_LEADS_SQL = f"{_CRAWL_SQL}, {_SETTLE_SQL}"
_FRESH = "EXISTS (SELECT 1 FROM visits v WHERE v.root_order = f.root_order AND v.order_path = f.order_path)"
_EVENTS_SQL = f"""{_LEADS_SQL},
events_all AS (
  SELECT DISTINCT CAST(0 AS BIGINT) AS seq, 'QUERY: ' || query AS node_id, 'query' AS state, 'Search Engine Query' AS title, CAST(NULL AS VARCHAR) AS parent_id FROM f0
  UNION ALL SELECT depth * 100 + 10, url, 'pending', 'Depth: ' || depth, parent_id FROM frontier
  UNION ALL SELECT depth * 100 + 20, url, 'skip', 'Visited or Depth Limit', NULL FROM frontier f WHERE NOT {_FRESH}
  UNION ALL SELECT depth * 100 + 30, url, 'prune', 'Junk Domain Match', NULL FROM visits WHERE outcome = 'junk'
  UNION ALL SELECT depth * 100 + 40, url, 'prune', 'Extraction Failed', NULL FROM visits WHERE outcome = 'blank'
  UNION ALL SELECT depth * 100 + 50, url, 'prune', 'Reason: ' || summary, NULL FROM visits WHERE outcome = 'PRUNE'
  UNION ALL SELECT len(f.order_path) * 100 + 50, f.url, 'skip', 'Already Contacted', NULL FROM found f LEFT JOIN leads l ON l.root_order = f.root_order
    WHERE l.order_path IS NULL OR f.order_path < l.order_path
  UNION ALL SELECT len(order_path) * 100 + 50, url, 'convert', 'LEAD: ' || company, NULL FROM leads
  UNION ALL SELECT 500 + 3 - depth, url, CASE WHEN n_leads > 0 THEN 'convert' ELSE 'prune' END, 'Branch Result: ' || summary, NULL FROM branches)"""
_NODES_SQL = f"""{_EVENTS_SQL},
last_state AS (SELECT node_id, arg_max((state, title), seq) AS l, count(*) AS n_updates FROM events_all GROUP BY node_id),
labels_of AS (SELECT *, l[1] AS state, l[2] AS title, CASE WHEN starts_with(node_id, 'QUERY:') THEN node_id
    WHEN regexp_extract(node_id, '^[a-z]+:(?://[^/?#]*)?([^?#;]*)', 1) <> '' THEN regexp_extract(node_id, '^[a-z]+://([^/?#]*)', 1) ||
      left(regexp_extract(node_id, '^[a-z]+:(?://[^/?#]*)?([^?#;]*)', 1), 15) || '...'
    ELSE regexp_extract(node_id, '^[a-z]+://([^/?#]*)', 1) END AS label FROM last_state),
nodes AS (SELECT node_id, CASE WHEN length(label) > 35 THEN left(label, 32) || '...' ELSE label END AS label, state,
    CASE state WHEN 'query' THEN '#8A2BE2' WHEN 'pending' THEN '#FFD700' WHEN 'convert' THEN '#32CD32' WHEN 'skip' THEN '#A9A9A9' ELSE '#FF4500' END AS colour,
    title, n_updates FROM labels_of),
edges AS (SELECT DISTINCT parent_id AS source, node_id AS target FROM events_all WHERE parent_id <> '' AND parent_id <> node_id
    AND parent_id IN (SELECT node_id FROM nodes) AND node_id IN (SELECT node_id FROM nodes))"""


@query("crawl_frontier", f"""{_CRAWL_SQL}
SELECT f.root_order, array_to_string(f.order_path, '.') AS order_path, CAST(f.depth AS BIGINT) AS depth, f.url, f.parent_id,
  v.outcome IS NOT NULL AS fresh, coalesce(v.outcome, 'skipped') AS outcome, coalesce(array_to_string(v.ledger, chr(10)), '') AS ledger
FROM frontier f LEFT JOIN visits v ON v.root_order = f.root_order AND v.order_path = f.order_path""")
def crawl_frontier(spark, sf):
    result = crawled(spark, sf)
    visits = result.visits.select("root_order", "order_path", "outcome", F.col("ledger").alias("trail"))
    rows = result.frontier.join(visits, ["root_order", "order_path"], "left")
    return rows.select(
        "root_order", F.array_join("order_path", ".").alias("order_path"), F.col("depth").cast("bigint").alias("depth"), "url",
        "parent_id", "fresh", F.coalesce("outcome", F.lit("skipped")).alias("outcome"),
        F.coalesce(F.array_join("trail", "\n"), F.lit("")).alias("ledger"))


@query("first_lead_per_root", f"""{_LEADS_SQL}
SELECT root_order, array_to_string(order_path, '.') AS order_path, query, url, company, email FROM leads""")
def first_lead_per_root(spark, sf):
    _, outcome = hunted(spark, sf)
    return outcome.leads.select("root_order", F.array_join("order_path", ".").alias("order_path"), "query", "url", "company", "email")


@query("branch_rollup", f"""{_LEADS_SQL}
SELECT url, CAST(depth AS BIGINT) AS depth, summary, n_leads, CASE WHEN n_leads > 0 THEN 'convert' ELSE 'prune' END AS state FROM branches""")
def branch_rollup(spark, sf):
    _, outcome = hunted(spark, sf)
    return outcome.branches.select("url", F.col("depth").cast("bigint").alias("depth"), "summary", "n_leads", "state")


@query("leads_per_query", f"""{_LEADS_SQL}
SELECT f.query, f.n_roots, coalesce(n, 0) AS n_leads FROM (SELECT query, count(*) AS n_roots FROM f0 GROUP BY query) f
LEFT JOIN (SELECT query, count(*) AS n FROM leads GROUP BY query) l ON l.query = f.query""")
def leads_per_query(spark, sf):
    result, outcome = hunted(spark, sf)
    return C.leads_per_query(result, outcome.leads).select("query", "n_roots", "n_leads")


@query("funnel_by_depth", f"""{_CRAWL_SQL}
SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n_pages, count(*) FILTER (WHERE outcome = 'CONVERT') AS n_convert,
  count(*) FILTER (WHERE outcome = 'FOLLOW') AS n_follow, count(*) FILTER (WHERE outcome IN ('junk', 'blank', 'PRUNE')) AS n_prune,
  round(count(*) FILTER (WHERE outcome = 'CONVERT') / count(*), 6) AS conversion_rate FROM visits GROUP BY depth""")
def funnel_by_depth(spark, sf):
    return C.funnel_by_depth(crawled(spark, sf))


@query("node_events", f"{_EVENTS_SQL} SELECT seq, node_id, state, title, parent_id FROM events_all")
def node_events(spark, sf):
    return hunted(spark, sf)[1].events


@query("graph_nodes", f"{_NODES_SQL} SELECT node_id, label, state, colour, title, n_updates FROM nodes")
def graph_nodes(spark, sf):
    return G.graph_nodes(hunted(spark, sf)[1].events)


@query("graph_edges", f"{_NODES_SQL} SELECT source, target FROM edges")
def graph_edges(spark, sf):
    events = hunted(spark, sf)[1].events
    return G.graph_edges(events, G.graph_nodes(events))


@query("graph_export", f"""{_NODES_SQL}
SELECT 'node' AS kind, node_id AS source, CAST(NULL AS VARCHAR) AS target, state FROM nodes
UNION ALL SELECT 'edge', source, target, NULL FROM edges""")
def graph_export(spark, sf):
    events = hunted(spark, sf)[1].events
    nodes = G.graph_nodes(events)
    edges = G.graph_edges(events, nodes)
    path = scratch_path(spark, "graph")
    export_graph(nodes, edges, path, "json")
    nodes, edges = import_graph(spark, path, nodes.schema, edges.schema, "json")
    none = F.lit(None).cast("string")
    return nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("source"), none.alias("target"), "state").unionByName(
        edges.select(F.lit("edge").alias("kind"), "source", "target", none.alias("state")))


@query("state_changes", """
SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
WHERE before IS NULL OR before <> event_type""")
def state_changes(spark, sf):
    events = read_table(spark, sf, "events", ["event_id", "user_id", "event_type"]).select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("node_id"), F.col("event_type").alias("state"),
        F.lit("").alias("title"))
    return G.state_changes(events).select(F.col("seq").alias("event_id"), F.col("node_id").alias("user_id"),
                                          F.col("state").alias("event_type"))


@query("crawl_min_depth", """
WITH RECURSIVE e AS (SELECT DISTINCT 'https://s' || l_suppkey || '.test' AS s, 'https://p' || l_partkey || '.test' AS p FROM lineitem),
both_ways AS (SELECT s AS source, p AS target FROM e UNION ALL SELECT p, s FROM e),
best AS (SELECT source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY target) AS rn FROM both_ways) WHERE rn <= 4),
reach AS (SELECT 'https://s' || s_suppkey || '.test' AS url, 0 AS depth FROM supplier WHERE s_acctbal < 0
  UNION SELECT target, depth + 1 FROM reach JOIN best ON source = url WHERE depth < 3)
SELECT url, CAST(min(depth) AS BIGINT) AS depth FROM reach GROUP BY url""")
def crawl_min_depth(spark, sf):
    """Suppliers and parts as sites that link to each other through line items."""
    name = lambda prefix, c: F.concat(F.lit(f"https://{prefix}"), F.col(c).cast("string"), F.lit(".test"))
    pairs = write_scratch(read_table(spark, sf, "lineitem", ["l_suppkey", "l_partkey"]).distinct(), "pairs")
    # Two numbers take a few bytes of a shuffle, two links of two URLs far more of a task's memory: tasks go by rows here.
    tasks = max(parallelism(spark), pairs.count() // PAIRS_PER_TASK + 1)
    items = pairs.repartition(tasks, "l_suppkey", "l_partkey").select(
        name("s", "l_suppkey").alias("s"), name("p", "l_partkey").alias("p"))
    links = items.select(F.explode(F.array(F.struct(F.col("s").alias("source"), F.col("p").alias("url")),
                                           F.struct(F.col("p").alias("source"), F.col("s").alias("url")))).alias("l")).select("l.*")
    # The best four links of a page come in order of their pages, so that gathering them sorts and hashes nothing.
    best = P.top_links(links, ["source"], max_leafs=4, unique=True)
    four = [F.max(F.when(F.col("leaf") == i, F.col("url"))) for i in range(1, 5)]
    pages = best.groupBy(F.col("source").alias("url")).agg(F.array_compact(F.array(*four)).alias("links"))
    pages = write_scratch(pages, "site")
    discard(pairs)
    start = read_table(spark, sf, "supplier").where("s_acctbal < 0").select(
        F.col("s_suppkey").alias("root_order"), F.lit("suppliers").alias("query"), name("s", "s_suppkey").alias("href"))
    follow = F.struct(F.lit("FOLLOW").alias("decision"), F.lit("linked").alias("discovery_summary"),
                      F.coalesce("links", F.array().cast("array<string>")).alias("next_target_urls"),
                      *[F.lit(None).cast("string").alias(c) for c in ("company", "person", "email")])
    result = C.crawl(start, pages, lambda df: df.withColumn("text", F.col("url")),
                     lambda df: df.withColumn("decision", follow), config=HuntConfig(max_depth=3, max_leafs=4))
    return result.visits.select("url", F.col("depth").cast("bigint").alias("depth"))


@query("hunt_cycle", f"""WITH RECURSIVE {HITS_SQL}, {_SITE_SQL.strip()}
{_rounds_sql(3, 4, "SELECT CASE query WHEN 'lang de' THEN 0 WHEN 'lang en' THEN 10 WHEN 'lang es' THEN 20 ELSE 30 END + hit_rank - 1 AS root_order, query, href FROM hits")},
{_SETTLE_SQL},
first_rows AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY root_order) AS rn FROM leads)
SELECT email, company AS company_name, 'Unknown' AS founder_name, 'topic match with e-mail' AS reason, false AS contacted,
  false AS delivery_failed, TIMESTAMP '2026-03-15 00:00:00' AS date_found FROM first_rows
WHERE rn = 1 AND email NOT IN (SELECT email FROM stored)""")
def hunt_cycle(spark, sf):
    """Search hits to new rows of the lead store, all steps in one go."""
    order = F.create_map(*[F.lit(x) for pair in (("lang de", 0), ("lang en", 1), ("lang es", 2), ("lang fr", 3)) for x in pair])
    results = search.results(spark, sf).withColumn("query_order", F.try_element_at(order, F.col("query")))
    config = replace(CONFIG, blocked_tlds=search.CONFIG.blocked_tlds, blocked_hosts=search.CONFIG.blocked_hosts)
    store = stored_leads(spark, sf)
    cycle = run_cycle(results, site(spark, sf), store, verdicts(spark, sf), observe, evaluate,
                      F.expr("TIMESTAMP_NTZ '2026-03-15 00:00:00'"), config=config)
    return cycle.new_leads
