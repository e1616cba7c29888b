"""Campaigns, queries, search results and corpus search."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.catalog.registry import query
from leadloom.config import FALLBACK_QUERY, HuntConfig, NO_LOCATION_TEXT
from leadloom.functions.urls import with_normalized_url
from leadloom.operators import campaigns as K, search as R
from leadloom.sources.tables import read_for_parsing, read_table


def campaigns(spark, sf):
    """One campaign per customer; those in debt have no target locations."""
    places = read_table(spark, sf, "nation").join(
        read_table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = read_table(spark, sf, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    here = F.when(F.col("c_acctbal") < 0, F.array().cast("array<string>")).otherwise(F.array("n_name", "r_name"))
    return c.select(F.col("c_custkey").alias("campaign_id"), here.alias("locations"),
                    F.concat(F.lit(" Find "), F.lower("c_mktsegment"), F.lit(" firms in {locations}. ")).alias("intent"))


_CAMPAIGNS = """
campaigns AS (SELECT c_custkey AS campaign_id, CASE WHEN c_acctbal < 0 THEN CAST([] AS VARCHAR[]) ELSE [n_name, r_name] END AS locations,
    ' Find ' || lower(c_mktsegment) || ' firms in {locations}. ' AS intent
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query("campaign_intent", f"""WITH {_CAMPAIGNS},
t AS (SELECT *, CASE WHEN len(locations) = 0 THEN '{NO_LOCATION_TEXT}' ELSE array_to_string(locations, ', ') END AS location_text FROM campaigns)
SELECT campaign_id, location_text, replace(trim(intent), '{{locations}}', location_text) AS intent FROM t""")
def campaign_intent(spark, sf):
    return K.campaign_intent(campaigns(spark, sf)).select("campaign_id", "location_text", "intent")


def categories(spark, sf):
    """Two queries per region (a handful of rows): its suppliers and its makers."""
    rows = read_table(spark, sf, "region", ["r_regionkey", "r_name"]).orderBy("r_regionkey").collect()
    return [(r.r_name, 2, (f"{r.r_name.lower()} suppliers", f"{r.r_name.lower()} makers")) for r in rows]


DISCOVERY = ("contact", "imprint")


_QUERIES = f"""{_CAMPAIGNS},
slots AS (SELECT 2 * r_regionkey + i AS slot, r_name AS category,
    lower(r_name) || [' suppliers', ' makers'][i + 1] AS phrase, ['contact', 'imprint'][i + 1] AS discovery
  FROM region, (SELECT unnest([0, 1]) AS i)),
queries AS (SELECT campaign_id, CAST(slot AS BIGINT) AS slot, category, locations[slot % len(locations) + 1] AS location,
    '"' || phrase || '" AND "' || locations[slot % len(locations) + 1] || '" AND "' || discovery || '"' AS query
  FROM campaigns, slots WHERE len(locations) > 0)"""


@query("campaign_queries", f"WITH {_QUERIES} SELECT campaign_id, slot, category, location, query FROM queries")
def campaign_queries(spark, sf):
    return K.campaign_queries(campaigns(spark, sf), categories(spark, sf), DISCOVERY)


@query("campaign_query_check", f"""WITH {_QUERIES},
sets AS (SELECT c.campaign_id, locations, coalesce(qs, ['{FALLBACK_QUERY}']) AS qs FROM campaigns c LEFT JOIN
  (SELECT campaign_id, list(query) AS qs FROM queries GROUP BY campaign_id) q ON c.campaign_id = q.campaign_id),
n AS (SELECT campaign_id, len(qs) AS n_queries, len(list_filter(qs, lambda q:
    len(list_filter(locations, lambda p: contains(lower(q), lower(p)))) > 0)) AS n_located,
    len(list_filter(qs, lambda q: regexp_matches(lower(q), 'jobs|hiring|salary'))) AS n_generic FROM sets)
SELECT *, n_queries BETWEEN 5 AND 10 AND n_located = n_queries AND n_generic = 0 AS passed FROM n""")
def campaign_query_check(spark, sf):
    every = campaigns(spark, sf)
    return K.check_query_sets(K.with_fallback_query(every, K.campaign_queries(every, categories(spark, sf), DISCOVERY)))


def results(spark, sf):
    """Stored pages as raw search hits, one query per language section; some have no href."""
    pages = read_table(spark, sf, "pages", ["page_id", "url"])
    return pages.select(
        F.concat(F.lit("lang "), F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]+)/", 1)).alias("query"),
        F.col("page_id").alias("position"),
        F.when(F.col("url").contains("spam-farm"), F.lit(None)).when(F.col("url").contains("cheap-pills"), "")
        .otherwise(F.col("url")).alias("href"))


CONFIG = HuntConfig(blocked_tlds=(".org",), blocked_hosts=("tion.example.net",))
HITS_SQL = r"""
results AS (SELECT 'lang ' || regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1) AS query, page_id AS position,
    CASE WHEN contains(url, 'spam-farm') THEN NULL WHEN contains(url, 'cheap-pills') THEN '' ELSE url END AS href FROM pages),
raw AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY position) AS rn FROM results),
usable AS (SELECT * FROM raw WHERE rn <= 30 AND href <> '' AND
    NOT regexp_matches(regexp_extract(href, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1), '(?:\.org|tion\.example\.net)$')),
hits AS (SELECT * FROM (SELECT query, position, href, row_number() OVER (PARTITION BY query ORDER BY position) AS hit_rank
    FROM usable) WHERE hit_rank <= 10)"""


@query("search_topn", f"WITH {HITS_SQL} SELECT query, position, href, hit_rank FROM hits")
def search_topn(spark, sf):
    hits = R.search_topn(results(spark, sf), 10, CONFIG)
    return hits.withColumn("hit_rank", F.col("hit_rank").cast("bigint"))


@query("hits_to_pages", f"""WITH {HITS_SQL}
SELECT query, position, rtrim(regexp_replace(href, '#.*', ''), '/') AS url, page_id FROM results JOIN pages
ON rtrim(regexp_replace(href, '#.*', ''), '/') = rtrim(regexp_replace(pages.url, '#.*', ''), '/') WHERE href <> ''""")
def hits_to_pages(spark, sf):
    pages = read_table(spark, sf, "pages", ["page_id", "url"])
    return R.hits_to_pages(results(spark, sf), pages).select("query", "position", "url", "page_id")


def phrase_queries(spark, sf):
    """Each benchmark item as a boolean query: its sentences, quoted and joined by AND."""
    items = read_table(spark, sf, "benchmark")
    sentences = F.filter(F.transform(F.split("text", r"[.\n\"]+"), F.trim), lambda s: s != "")
    return items.select(F.col("item_id").alias("query_id"), F.concat(
        F.lit('"'), F.array_join(sentences, '" AND "'), F.lit('"')).alias("query"))


@query("corpus_search", r"""
WITH q AS (SELECT item_id AS query_id, list_distinct(list_filter(list_transform(string_split_regex(lower(text), '[.\n"]+'),
             lambda s: list_filter(string_split_regex(s, '[^\p{L}\p{N}]+'), lambda w: w <> '')), lambda p: len(p) > 0)) AS phrases FROM benchmark),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words FROM documents),
m AS (SELECT query_id, doc_id, list_transform(phrases, lambda p: len(list_filter(generate_series(1, len(words) - len(p) + 1),
          lambda i: words[i] = p[1] AND words[i:i + len(p) - 1] = p))) AS counts
      FROM q JOIN d ON len(phrases) > 0 AND list_has_all(words, flatten(phrases)))
SELECT query_id, doc_id, score, position FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position
  FROM (SELECT query_id, doc_id, list_sum(counts)::BIGINT AS score FROM m WHERE NOT list_contains(counts, 0))) WHERE position <= 10""")
def corpus_search(spark, sf):
    found = R.corpus_search(R.parse_boolean_query(phrase_queries(spark, sf)),
                            read_for_parsing(spark, sf, "documents", ["doc_id", "text"]))
    return found.withColumn("position", F.col("position").cast("bigint"))
