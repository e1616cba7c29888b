"""The URL filter against plain Python: places, rules, grams, scores over a whole table, and the fit on a small one."""

import math
import os
import re
import sys
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from leadloom.llm import url_table, urls  # noqa: E402
from leadloom.llm.entries import QUERIES  # noqa: E402

SMALL = "/root/testdata/sf0.001"
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def place(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def ruled(host, path):
    fits = [r for r in RULES if ("." + host).endswith("." + r.split("/")[0]) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


def features(host, path):
    every = set()
    for kind, s in (("h", "^" + host + "$"), ("p", "^" + path + "$")):
        for n in (3, 4, 5):
            every |= {kind + s[i:i + n] for i in range(len(s) - n + 1)}
    return {zlib.crc32(g.encode("utf-8", "replace")) % 2**18 for g in every}


def logistic(z):
    return 1 / (1 + math.exp(-z))


def test_every_row_of_a_table(spark):
    odd = [None, "", "no scheme", "://", "HTTP://EXAMPLE.org/en/1?x", "http://a.example.org/es/", "http://xexample.org/es/", "x://com/fr/#y", "https://n.com/de", "a://b://c/d"]
    named = [(u, label) for u, _, _, label in url_table.labelled()]
    model = urls.fit(spark.createDataFrame([(*place(u), label) for u, label in named], "host string, path string, label int"))
    got = QUERIES["op4_url_filter"](spark, SMALL).collect()
    rows = {r.page_id: r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").collect()}
    assert len(got) == len(rows)
    extra = urls.judged(spark.createDataFrame(list(enumerate(odd, 10**6)), "page_id long, url string"), model).select(
        F.col("id").alias("page_id"), "host", "path", "rule", "verdict", F.round("score", 4).alias("score")).collect()
    rows |= dict(enumerate(odd, 10**6))
    seen = set()
    for r in got + extra:
        host, path = place(rows[r.page_id])
        rule, found = ruled(host, path), features(host, path)
        score = logistic(model.bias + (sum(model.weights[f] for f in found) / math.sqrt(len(found)) if found else 0.0))
        verdict = RULES[rule] if rule else "block" if score >= 0.5 else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict) and abs(r.score - score) < 1e-3
        seen.add((rule is None, verdict))
    assert len(seen) == 4


def test_the_fit_by_plain_python(spark):
    table = url_table.labelled()
    rows = sorted({(*place(u), label) for u, _, _, label in table[:: len(table) // 30]})
    assert len({r[2] for r in rows}) == 2
    model = urls.fit(spark.createDataFrame(rows, "host string, path string, label int"), rounds=25)
    found, n = [features(h, p) for h, p, _ in rows], {y: sum(r[2] == y for r in rows) for y in (0, 1)}
    weights, speed, bias, bias_speed = defaultdict(float), defaultdict(float), 0.0, 0.0
    for _ in range(25):
        slopes = []
        for f, (_, _, y) in zip(found, rows):
            z = bias + sum(weights[k] for k in f) / math.sqrt(len(f))
            slopes.append((logistic(z) - y) * (0.3 if y else 0.7) / n[y])
        step = defaultdict(float)
        for f, s in zip(found, slopes):
            for k in f:
                step[k] += s / math.sqrt(len(f))
        for k in step:
            speed[k] = 0.9 * speed[k] - 20.0 * (step[k] + 1e-5 * weights[k])
        bias_speed = 0.9 * bias_speed - 2.0 * sum(slopes)
        for k in step:
            weights[k] += speed[k]
        bias += bias_speed
    assert abs(model.bias - bias) < 1e-9 and max(abs(model.weights[k] - w) for k, w in weights.items()) < 1e-9
