"""Stores in buckets: lookups read the buckets of the wanted keys only, and give what a plain join gives."""

import re

import pytest
from pyspark.sql import functions as F

from leadloom.functions.urls import url_hash
from leadloom.plans import crawl as C
from leadloom.session import scratch_path, write_scratch
from leadloom.sources.buckets import BucketStore, matching, missing, write_buckets
from leadloom.sources.tables import append_visited
from test_crawl import SITE, run, settle


@pytest.fixture(scope="module")
def store(spark):
    rows = spark.range(5000).select(F.concat(F.lit("https://h"), F.col("id").cast("string"), F.lit(".test")).alias("url"),
                                    F.col("id").alias("n"), F.lit("x").alias("of_what"))
    path = scratch_path(spark, "pages")
    write_buckets(rows, path, "url", buckets=40, files=2)
    return BucketStore.open(spark, path, "url")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup_reads_only_its_buckets(spark, store):
    wanted = write_scratch(spark.createDataFrame([("https://h7.test",), ("https://h9.test",), ("https://none.test",), (None,)], "url string"), "w")
    found = store.matching(wanted)
    assert sorted((r.url, r.n) for r in found.collect()) == [("https://h7.test", 7), ("https://h9.test", 9)]
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan_of(found))
    read = {f.split("bucket=")[1].split("/")[0] for f in store.holding(wanted).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert 0 < len(read) <= 3  # of 40
    assert sorted(r.url or "" for r in store.missing(wanted).collect()) == ["", "https://none.test"]
    assert store.rows().count() == 5000 and store.rows().columns == ["url", "n", "of_what"]


def test_plain_tables_and_stores_agree(spark, store):
    wanted = write_scratch(spark.range(4900, 5100).select(F.format_string("https://h%d.test", "id").alias("url"), F.col("id").alias("k")), "w")
    plain = store.rows()
    for f in (matching, missing):
        a, b = (sorted(map(str, f(s, wanted, "url").select("url", "k").collect())) for s in (store, plain))
        assert a == b and len(a) == 100


def test_no_wanted_keys(spark, store):
    none = write_scratch(spark.createDataFrame([], "url string"), "w")
    assert store.matching(none).count() == store.missing(none).count() == 0


def test_buckets_are_bounded(spark):
    with pytest.raises(ValueError):
        write_buckets(spark.range(1), scratch_path(spark, "x"), "id", buckets=100_000)


def test_crawl_from_stores(spark):
    """A crawl over bucket stores opens the same pages as one over plain tables, also with URLs visited before."""
    pages = spark.createDataFrame(SITE, "url string, html string")
    path, seen_path = scratch_path(spark, "pages"), scratch_path(spark, "visited")
    write_buckets(pages, path, "url", buckets=16)
    seen = spark.createDataFrame([("https://one.test/team",), ("https://else.test",)], "url string").select(
        url_hash(F.col("url")).alias("url_hash"), "url")
    write_buckets(seen.withColumn("visited_at", F.current_timestamp()), seen_path, "url_hash", buckets=8)
    hits = ["https://one.test/", "https://two.test/#x"]
    plain = run(spark, hits, visited=seen.select("url_hash"))
    visited = BucketStore.open(spark, seen_path, "url_hash")
    roots = spark.createDataFrame([(i, "q", h) for i, h in enumerate(hits)], "root_order long, query string, href string")
    from leadloom.config import HuntConfig
    from leadloom.operators.evaluate import evaluate_by_rules
    from test_crawl import OBSERVE

    stored = C.crawl(roots, BucketStore.open(spark, path, "url"), OBSERVE, lambda df: evaluate_by_rules(df), visited,
                     HuntConfig(junk_domains=("junk.test",)))
    key = ["url", "outcome", "depth", "root_order"]
    assert sorted(map(tuple, stored.visits.select(*key).collect())) == sorted(map(tuple, plain.visits.select(*key).collect()))
    assert "https://one.test/team" not in {r.url for r in stored.visits.collect()}
    # What was opened goes into the store; asked again, nothing is new.
    opened = stored.visits.select("url")
    added = append_visited(opened, visited, seen_path, F.current_timestamp())
    assert added.count() == opened.count()
    again = BucketStore.open(spark, seen_path, "url_hash")
    assert again.rows().count() == 2 + opened.count()
    assert append_visited(opened, again, seen_path, F.current_timestamp()).count() == 0


def test_unusable_urls_are_tried_and_fail(spark):
    """A hit or target that is no URL gets its events like any other page that can't be read."""
    site = [*SITE, ("https://odd.test", "<p>x</p>")]
    odd = F.struct(F.lit("FOLLOW").alias("decision"), F.lit("s").alias("discovery_summary"),
                   F.array(F.lit("http://[bad"), F.lit(""), F.lit("/ok")).alias("next_target_urls"),
                   *[F.lit(None).cast("string").alias(c) for c in ("company", "person", "email")])
    pages = spark.createDataFrame(site, "url string, html string")
    roots = spark.createDataFrame([(0, "q", "http://[bad"), (1, "q", "https://odd.test")], "root_order long, query string, href string")
    result = C.crawl(roots, pages, lambda df: df.withColumn("text", F.col("url")), lambda df: df.withColumn("decision", odd))
    events = {(r.node_id, r.title) for r in settle(spark, result).events.collect()}
    assert {("", "Depth: 0"), ("", "Extraction Failed"), ("", "Depth: 1"), ("", "Visited or Depth Limit")} <= events
    assert {r.outcome for r in result.visits.where("url = ''").collect()} == {"blank"}
