"""Phrase search on a positional index against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leadloom.operators import search as R
from leadloom.session import scratch_path
from leadloom.sources.buckets import BucketStore, write_buckets


def words(text):
    return [w for w in re.split(r"[^\w]+|_", text.lower()) if w]


def brute(queries, docs, top):
    out = []
    for q, phrases in queries:
        wanted = {tuple(words(p)) for p in phrases} - {()}
        rows = []
        for d, text in docs:
            w = words(text or "")
            counts = [sum(tuple(w[i:i + len(p)]) == p for i in range(len(w))) for p in wanted]
            if wanted and all(counts):
                rows.append((-sum(counts), d))
        out += [(q, k, d, -s) for k, (s, d) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    pool = ["the", "the", "the", "red", "apple", "pie", "Pie", "a", "is", "é", "x1"]
    docs = [(d, rng.choice([" ", ", ", " - "]).join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for d in range(150)]
    docs += [(900, None), (901, ""), (902, "... !"), (903, "the " * 3000 + "red apple")]
    queries = [(q, [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3))]) for q in range(40)]
    queries += [(100, ["the the"]), (101, ["the", "the"]), (102, ["unknown word"]), (103, []), (104, ["--"]), (105, ["Red, APPLE"]),
                (106, ["a", "--", "pie"]), (107, ["the the the the"])]
    return queries, docs


def test_phrases(spark, corpus):
    queries, docs = corpus
    asked = spark.createDataFrame(queries, "query_id long, phrases array<string>")
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    wanted = brute(queries, docs, 5)
    key = ["query_id", "position", "doc_id", "score"]
    assert sorted(map(tuple, R.corpus_search(asked, frame, 5).select(*key).collect())) == wanted
    # The same from an index of all words that was written before.
    path = scratch_path(spark, "index")
    write_buckets(R.positional_index(frame), path, "term", buckets=8)
    store = BucketStore.open(spark, path, "term")
    assert sorted(map(tuple, R.corpus_search(asked, None, 5, index=store).select(*key).collect())) == wanted
    assert len(wanted) > 60


def test_only_words_of_the_query_are_read(spark, corpus):
    path = scratch_path(spark, "index")
    write_buckets(R.positional_index(spark.createDataFrame(corpus[1], "doc_id long, text string")), path, "term", buckets=64)
    store = BucketStore.open(spark, path, "term")
    one = store.holding(spark.createDataFrame([("pie",)], "term string"))
    assert one.select(F.input_file_name()).distinct().count() == 1
    assert "pie" in {r.term for r in one.collect()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "query_id long, phrases array<string>")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert R.corpus_search(none, docs).count() == 0
    some = spark.createDataFrame([(1, ["a b"])], "query_id long, phrases array<string>")
    assert R.corpus_search(some, docs.where("false")).count() == 0
    assert R.corpus_search(some, docs).count() == 1
