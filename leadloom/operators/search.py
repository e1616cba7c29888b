"""Search results: blocked hosts, over-fetch then cap, hits to pages, corpus search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from leadloom.config import HuntConfig
from leadloom.functions.urls import has_blocked_host, with_normalized_url
from leadloom.session import write_scratch
from leadloom.sources.buckets import BucketStore

_TOKEN_GAP = r"[^\p{L}\p{N}]+"


def search_topn(results: DataFrame, num_results: int = 10, config: HuntConfig = HuntConfig(),
                strict_hosts: bool = False) -> DataFrame:
    """First ``num_results`` usable hits among the first ``multiplier * num_results`` raw hits.

    Input: query, position, href. Both limits become row_number filters, which
    Spark applies before it shuffles, so a query with very many hits sends few.
    """
    by_position = Window.partitionBy("query").orderBy("position")
    raw = results.select("query", "position", "href").withColumn(
        "raw_rank", F.row_number().over(by_position)
    ).where(F.col("raw_rank") <= num_results * config.fetch_multiplier)
    usable = raw.where(F.col("href").isNotNull() & (F.col("href") != "")).where(
        ~has_blocked_host(F.col("href"), config.blocked_tlds, config.blocked_hosts, strict_hosts))
    return usable.withColumn("hit_rank", F.row_number().over(by_position)).where(
        F.col("hit_rank") <= num_results).drop("raw_rank")


def hits_to_pages(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Inner join of hits to stored pages on the normalised URL.

    Only key columns of ``pages`` should be passed when the HTML is not needed.
    A URL that very many hits share is split by adaptive skew handling: the hit
    side is cut, the one matching page row is repeated.
    """
    hits = with_normalized_url(hits, "href", "href", "url")
    stored = with_normalized_url(pages, "url", "url", "norm_url").drop("url")
    return hits.where("url != ''").join(stored, hits["url"] == stored["norm_url"]).drop("norm_url")


def parse_boolean_query(queries: DataFrame, query: str = "query") -> DataFrame:
    """Add ``phrases``: the quoted phrases of '"a b" AND "c"', lower-cased, distinct.

    A query without quotes is searched by its words, joined by AND.
    """
    quoted = F.regexp_extract_all(F.lower(F.col(query)), F.lit(r'"([^"]+)"'), F.lit(1))
    listed = F.array_distinct(F.filter(F.transform(quoted, lambda p: F.trim(p)), lambda p: p != ""))
    words = F.filter(_tokens(F.col(query)), lambda w: ~w.isin("and", "or"))
    return queries.withColumn("phrases", listed).withColumn(
        "phrases", F.when(F.size("phrases") == 0, words).otherwise(F.col("phrases")))


def _tokens(text):
    return F.filter(F.array_distinct(F.split(F.lower(text), _TOKEN_GAP)), lambda t: t != "")


def words_of(text: Column) -> Column:
    """The words of a text in order, lower-cased: runs of letters and digits."""
    return F.filter(F.split(F.lower(text), _TOKEN_GAP), lambda t: t != "")


def positional_index(documents: DataFrame, terms: DataFrame | None = None, doc_id: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """(term, doc_id, positions): where each word stands in each document, counted in words, ascending.

    ``terms`` (column term, distinct) keeps the words of some queries only;
    without it all words are indexed, and the table can be written once, best as
    a bucket store by term. ``doc_id`` is unique. The words of a document meet in
    the task that reads it, so only (term, document) rows are shuffled.
    """
    placed = documents.select(F.col(doc_id).alias("doc_id"), F.posexplode(words_of(F.col(text))).alias("place", "term"))
    if terms is not None:
        placed = placed.join(terms.select("term"), "term", "left_semi")
    return placed.groupBy("term", "doc_id").agg(F.sort_array(F.collect_list("place")).alias("positions"))


def phrase_matches(phrases: DataFrame, index: DataFrame) -> DataFrame:
    """(phrase, doc_id, n): how often the words of each phrase stand next to each other in a document.

    phrases: distinct strings. The rarest word of a phrase gives the places
    where it may start; every other word, shifted by its offset, must be at the
    same places. So a phrase pays for the list of its rarest word, and lists of
    its frequent words are read for those documents only.
    """
    placed = phrases.select("phrase", F.posexplode(words_of(F.col("phrase"))).alias("offset", "term"))
    frequency = index.groupBy("term").agg(F.count("*").alias("df"))
    # A word without a list rules its phrase out: df 0 is the smallest.
    ranked = placed.join(frequency, "term", "left").groupBy("phrase").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("offset"), F.col("term"))).alias("first"),
        F.count("*").alias("words")).where("first.df > 0")
    lists = index.select("term", "doc_id", "positions")
    starts = ranked.select("phrase", "words", F.col("first.offset").alias("own"), F.col("first.term").alias("term")).join(
        lists, "term").select("phrase", "words", "own", "doc_id", F.filter(
            F.transform("positions", lambda p: p - F.col("own")), lambda s: s >= 0).alias("starts"))
    others = starts.join(placed.withColumnRenamed("term", "other"), "phrase").where("offset <> own").join(
        lists.withColumnRenamed("term", "other"), ["other", "doc_id"])
    met = others.select("phrase", "doc_id", "words", F.explode(F.array_intersect(
        "starts", F.transform("positions", lambda p: p - F.col("offset")))).alias("start"))
    whole = met.groupBy("phrase", "doc_id", "start").agg(F.count("*").alias("n"), F.first("words").alias("words")).where("n = words - 1")
    longer = whole.groupBy("phrase", "doc_id").agg(F.count("*").alias("n"))
    single = starts.where("words = 1").select("phrase", "doc_id", F.size("starts").cast("bigint").alias("n"))
    return single.unionByName(longer)


def corpus_search(queries: DataFrame, documents: DataFrame | None = None, num_results: int = 10,
                  keys: Sequence[str] = ("query_id",), doc_id: str = "doc_id", text: str = "text",
                  index: DataFrame | BucketStore | None = None) -> DataFrame:
    """Documents that hold all phrases of each query, best first.

    Input queries: keys + ``phrases``. A phrase occurs where its words stand
    next to each other, whatever stands between them; case doesn't matter. The
    score is the number of phrase occurrences, ties go to the lower document id.

    Works on a positional index, never on texts: ``index`` is one that was
    written before (a bucket store by term is read for the words of the queries
    only), else one of the queries' words is made by one scan of ``documents``.
    A phrase that several queries hold is looked up once.
    """
    asked = queries.select(*keys, F.array_distinct(F.filter(F.transform(
        "phrases", lambda p: F.array_join(words_of(p), " ")), lambda p: p != "")).alias("phrases")).where(F.size("phrases") > 0)
    asked = write_scratch(asked, "queries")
    phrases = asked.select(F.explode("phrases").alias("phrase")).distinct()
    terms = write_scratch(phrases.select(F.explode(words_of(F.col("phrase"))).alias("term")).distinct(), "terms")
    if index is None:
        lists = positional_index(documents, terms, doc_id, text)
    else:
        lists = index.holding(terms).drop("bucket") if isinstance(index, BucketStore) else index
        lists = lists.join(terms, "term", "left_semi")
    found = phrase_matches(phrases, write_scratch(lists, "postings"))
    each = asked.select(*keys, F.size("phrases").alias("wanted"), F.explode("phrases").alias("phrase")).join(found, "phrase")
    scored = each.groupBy(*keys, "doc_id").agg(
        F.sum("n").alias("score"), F.count("*").alias("held"), F.first("wanted").alias("wanted")).where("held = wanted")
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), doc_id)
    return (scored.select(*keys, F.col("doc_id").alias(doc_id), "score")
            .withColumn("position", F.row_number().over(best)).where(F.col("position") <= num_results))
