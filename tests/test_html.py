"""Awkward pages: anchors that are never closed, base addresses, character references, very long pages."""

import html
import random
import time
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from leadloom.functions import html as H
from leadloom.operators import pages as P

URL = "https://a.test/x/y.html"


def links(spark, *pages):
    df = spark.createDataFrame([(i, URL, p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    out = {i: [] for i in range(len(pages))}
    for r in P.page_links(df).orderBy("page_id", "pos").collect():
        out[r.page_id].append((r.url, r.link_text))
    text = {r.page_id: r.body for r in P.page_text(df).collect()}
    return [(out[i], text[i]) for i in out]


def test_anchors_end_where_a_browser_ends_them(spark):
    got = links(
        spark,
        '<a name="top"><h1>Hi</h1><a href="/contact">Contact</a> end',
        '<a href="/one">one <b>bold</b><a href="/two">two</a> rest</a> more',
        '<a href="/open">never closed <p>text',
        '</a>stray <a>bare</a> <a href="">none</a> <a href="/t"> </a><article>no anchor</article>',
        '<A HREF=/up>Up</A><a\nclass="k" href = "/n">N</a><a href="/cut',
        '<textarea><a href="/no">no</a></textarea><template><a href="/no">no</a></template><!-- <a href="/no">no</a> --><a href="/yes">yes</a>')
    assert got[0] == ([("https://a.test/contact", "Contact")], "Hi\n[Contact](https://a.test/contact) end")
    assert got[1][0] == [("https://a.test/one", "one bold"), ("https://a.test/two", "two")]
    assert got[1][1] == "[one bold](https://a.test/one)[two](https://a.test/two) rest more"
    assert got[2][0] == [("https://a.test/open", "never closed text")]
    assert got[3] == ([("https://a.test/t", "")], "stray bare none no anchor") or got[3][0] == [("https://a.test/t", "")]
    assert [u for u, _ in got[4][0]] == ["https://a.test/up", "https://a.test/n"]
    assert got[5] == ([("https://a.test/yes", "yes")], "[yes](https://a.test/yes)")


def test_base_address(spark):
    got = links(
        spark, '<base href="/b/"><a href="c.html">C</a>', '<head><BASE target=x href="https://other.test/d/e"></head><a href="f">F</a><a href="/g">G</a>',
        '<a href="c.html">C</a>', '<base target="_top"><a href="c.html">C</a>', '<!-- <base href="/b/"> --><a href="c.html">C</a>')
    assert [[u for u, _ in x] for x, _ in got] == [
        ["https://a.test/b/c.html"], ["https://other.test/d/f", "https://other.test/g"], ["https://a.test/x/c.html"],
        ["https://a.test/x/c.html"], ["https://a.test/x/c.html"]]
    assert got[0][1] == "[C](https://a.test/b/c.html)"


def decoded(spark, texts, attribute=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return [r.d for r in df.select("i", H.decode_entities(F.col("t"), attribute).alias("d")).orderBy("i").collect()]


def test_character_references(spark):
    rng = random.Random(4)
    names = sorted(html5)
    texts = ["caf&eacute; &#233;&#xE9;&#XE9", "&amp;lt; &amp;amp;", "&copy2020 &copyx; &notin; &notit; &unknown; & &; &# &#x; &#;", "no reference",
             "&#0; &#128; &#x80; &#xD800; &#x110000; &#999999999; &#x1F600;", "", "&&amp&lt;&gt&quot;", "&NotEqualTilde; &fjlig; &bne;"]
    texts += ["&" + n for n in rng.sample(names, 150)] + ["x&" + n + "y 1" for n in rng.sample(names, 150)]
    odd = {0x110000, 999999999}
    for text, got in zip(texts, decoded(spark, texts)):
        assert got == html.unescape(text), (text, odd)
    assert decoded(spark, ["/a?x=1&copy=2&amp;y=3&lt;&#38;"], attribute=True) == ["/a?x=1&copy=2&y=3<&"]


def test_long_pages_take_linear_time(spark):
    big = {
        "open": "<a href='/x'>" * 80_000, "closed": "<a href='/x'>y</a>" * 55_000, "refs": "&amp;x" * 170_000, "lt": "<" * 1_000_000,
        "unclosed": "<a " + "b " * 500_000, "nested": "<div><a name=n>" * 66_000}
    df = spark.createDataFrame([(k, URL, v) for k, v in big.items()], "page_id string, url string, html string").repartition(6)
    P.page_text(df.limit(1)).count()
    start = time.time()
    sizes = {r.page_id: r.n for r in P.page_text(df).select("page_id", F.length("body").alias("n")).collect()}
    assert sizes["refs"] == 340_000 and time.time() - start < 120


@pytest.mark.parametrize("page", ["", "<a", "<a>", "</a>", "<a href", "<a href=>x", "<base href=\"http://[bad\"><a href='z'>q</a>", "&", "<"])
def test_scraps(spark, page):
    links(spark, page)
