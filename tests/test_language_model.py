"""The fitted language detector: scores by plain Python, and held-out accuracy beside the stop-word guard."""

import math
import os
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from leadloom.functions.language import detect_language
from leadloom.operators import language_model as M

FOLDER = "/root/testdata/sf0.01"


def grams(text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    return Counter(("_" + w + "_")[i:i + 3] for w in words for i in range(len(w)))


def brute(labelled, texts, most):
    counts = defaultdict(Counter)
    for lang, text in labelled:
        if lang is not None:
            counts[lang].update(grams(text))
    counts = {k: c for k, c in counts.items() if c}
    v = len({g for c in counts.values() for g in c})
    kept = {k: dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most]) for k, c in counts.items()}
    out = {}
    for i, text in texts:
        own = grams(text)
        scores = [(-sum(n * round(1000 * math.log((kept[k].get(g, 0) + 1) / (sum(c.values()) + v))) for g, n in own.items()), k)
                  for k, c in counts.items()]
        out[i] = (min(scores)[1] if own and scores else None, sum(own.values()))
    return out


def test_scores(spark):
    labelled = [("en", "the cat and the dog"), ("fr", "le chat et le chien"), ("de", "der hund und die katze"), ("en", None), (None, "zzz zzz"), ("xx", "123")]
    texts = [(1, "the chat"), (2, "und"), (3, ""), (4, None), (5, "123 !"), (6, "Le Chien, le chat"), (7, "qqq"), (8, "dog " * 5000)]
    model_rows = spark.createDataFrame(labelled, "lang string, text string")
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    for most in (3000, 4):
        got = {r.doc_id: (r.language, r.n_grams) for r in M.detect_languages(rows, M.fit_languages(model_rows, most=most)).collect()}
        assert got == brute(labelled, texts, most)
    none = M.detect_languages(rows, M.fit_languages(model_rows.where("false"))).collect()
    assert len(none) == 8 and all(r.language is None for r in none)
    assert M.detect_languages(rows.where("false"), M.fit_languages(model_rows)).count() == 0


def test_no_word_or_trigram_is_shuffled(spark):
    rows = spark.createDataFrame([(1, "the chat " * 50), (1, "und"), (None, "le chien"), (None, ""), (2, None)], "doc_id long, text string")
    labelled = [("en", "the cat"), ("fr", "le chat et le chien")]
    model = M.fit_languages(spark.createDataFrame(labelled, "lang string, text string"))
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = M.detect_languages(rows, model)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        got = {r.doc_id: (r.language, r.n_grams) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    # The texts meet the profiles by a broadcast, and are grouped by their keys only.
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1
    assert got == brute(labelled, [(1, "the chat " * 50 + "und"), (None, "le chien"), (2, None)], 3000)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang IS NOT NULL AND length(text) > 0")
    held = F.col("doc_id") % 5 == 0
    model = M.fit_languages(docs.where(~held))
    test = docs.where(held)
    found = M.detect_languages(test, model).join(test.select("doc_id", "lang", detect_language(F.col("text")).alias("guard")), "doc_id")
    row = found.agg(F.avg(
        F.col("language").eqNullSafe(F.col("lang")).cast("double")).alias("model"),
        F.avg(F.col("guard").eqNullSafe(F.col("lang")).cast("double")).alias("guard")).first()
    print(row)
    assert row.model >= 0.95 and row.model >= row.guard - 0.01
