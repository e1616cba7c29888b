from urllib.parse import urldefrag, urljoin

from hypothesis import HealthCheck, Phase, given, settings, strategies as st
from pyspark.sql import functions as F

from leadloom.functions import urls


def expected(base, target):
    if not target:
        return ""
    try:
        return urldefrag(urljoin(base, target))[0].rstrip("/")
    except ValueError:
        return ""


def absolute(base, target):
    """Before fragment and slashes are dropped; an empty fragment is not shown."""
    if not target:
        return ""
    try:
        body, fragment = urldefrag(urljoin(base, target))
    except ValueError:
        return ""
    return body + ("#" + fragment if fragment else "")


def both(spark, pairs):
    df = spark.createDataFrame(pairs, "base string, target string").withColumn("i", F.monotonically_increasing_id())
    df = urls.with_normalized_url(df, "base", "target", "url").withColumn(
        "absolute", urls.resolve_url(F.col("base"), F.col("target")))
    return [(r.url, r.absolute) for r in df.orderBy("i").collect()]


CASES = [
    ("https://test.com/page", "about/#contact-section", "https://test.com/about"),
    ("https://startup.com/about", "contact.html", "https://startup.com/contact.html"),
    ("https://a.com/x/y", "../z/./w", "https://a.com/z/w"),
    ("https://a.com/x/y", "//b.org/p/", "https://b.org/p"),
    ("https://a.com/x/y?q=1", "?p=2", "https://a.com/x/y?p=2"),
    ("https://a.com/x/y", "mailto:i@a.com", "mailto:i@a.com"),
    ("https://a.com/x/y", "javascript:void(0)", "javascript:void(0)"),
    ("https://a.com/x/y", "HTTPS://B.com/Q", "https://B.com/Q"),
    ("https://a.com/x/y", "../../../..", "https://a.com"),
    ("https://a.com/x/y", "https:foo", "https://a.com/x/foo"),
    ("https://a.com", "https://a.com/?q=/", "https://a.com/?q="),
    ("https://a.com/x", "   ", "https://a.com/x"),
    ("https://a.com", "http://[bad", ""),
    ("https://a.com", "", ""),
    ("https://a.com", None, ""),
    ("https://a.com", "#top", "https://a.com"),
    ("https://a.com", "x", "https://a.com/x"),
    ("https://a.com/b;p/c", ";x", "https://a.com/b;p/;x"),
    ("", "about/", "about"),
]


def test_cases(spark):
    got = both(spark, [(b, t) for b, t, _ in CASES])
    assert [g for g, _ in got] == [e for _, _, e in CASES]
    for b, t, e in CASES:
        assert expected(b, t) == e


SEGMENT = st.sampled_from(["", "a", "b.c", ".", "..", "x y", "é", ";p", "q;r", ";", "~"])
PATHS = st.lists(SEGMENT, max_size=6).map("/".join)
TAIL = st.sampled_from(["", "?", "?q=1", "?q=/a/../b/", "#", "#f/", "?q#f", "?a?b"])
TARGETS = st.builds(
    lambda s, n, p, t: s + n + p + t,
    st.sampled_from(["", "http:", "HTTPS:", "https:", "mailto:", "JavaScript:", "ftp:", " ", "1x:", "x-y:"]),
    st.sampled_from(["", "//h.org", "//H.org:8/", "//", "///", "//u@h", "//[bad", "//a]"]),
    PATHS, TAIL,
)
BASES = st.builds(
    lambda s, p, t: s + p + t,
    st.sampled_from(["https://a.com", "http://a.com/", "https://a.com/d/", "", "rel/", "ftp://f", "https:"]), PATHS, TAIL)


def test_many_combinations(spark):
    bases = ["https://a.com", "http://a.com/", "https://a.com/d/e?q=1#f", "https://a.com/x;p/y;q", "", "rel/x", "ftp://f/g", "#f", "?q"]
    heads = ["", "/", "//h.org", "//H.org:8/", "//", "//[bad", "https:", "HTTPS://b.com", "http://b.com/", "mailto:", " "]
    paths = ["", "a", "a/b/", "./", "../c", "../../../d/..", "a//b", ".", "..", "a/./b/../c", ";p", "a;p/b;q", "x y", "é", ";"]
    tails = ["", "?", "?q=1", "?q=/../", "#", "#f/", "?q#f"]
    pairs = [(b, h + p + t) for b in bases for h in heads for p in paths for t in tails]
    wrong = [(p, g, expected(*p)) for p, g in zip(pairs, both(spark, pairs)) if g != (expected(*p), absolute(*p))]
    assert not wrong, (len(wrong), wrong[:5])


@settings(max_examples=3, deadline=None, phases=[Phase.generate],
          suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(BASES, TARGETS), min_size=40, max_size=60))
def test_matches_standard_join(spark, pairs):
    got = both(spark, pairs)
    wrong = [(p, g, expected(*p)) for p, g in zip(pairs, got) if g != (expected(*p), absolute(*p))]
    assert not wrong, wrong[:5]


@settings(max_examples=1, deadline=None, phases=[Phase.generate],
          suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.text(), st.text()), min_size=20, max_size=40))
def test_any_text_gives_a_string_and_a_rank(spark, pairs):
    got = both(spark, pairs)
    assert all(isinstance(a, str) and isinstance(b, str) for a, b in got)
    df = spark.createDataFrame(pairs, "a string, b string").select(urls.rank_url(F.col("a")).alias("r"))
    assert {r.r for r in df.collect()} <= {0, 1, 2}


def test_rank(spark):
    cases = [("https://x.test/team-leadership", 0), ("https://x.test/products", 1),
             ("https://x.test/blog/2023-recap", 2), ("https://about.test/blog", 0), ("", 2), (None, 2)]
    df = spark.createDataFrame(cases, "u string, e int").select("e", urls.rank_url(F.col("u")).alias("r"))
    assert all(r.e == r.r for r in df.collect())


def test_blocklist(spark):
    rows = [("https://x.ru/", True, True), ("https://x.ru:8080/", False, True), ("https://x.RU/", False, True),
            ("https://myzhihu.com/a", True, False), ("https://ok.test/.ru", False, False), (None, False, False)]
    df = spark.createDataFrame(rows, "u string, plain boolean, strict boolean").select(
        "plain", "strict", urls.has_blocked_host(F.col("u")).alias("p"),
        urls.has_blocked_host(F.col("u"), strict_hosts=True).alias("s"))
    assert all(r.plain == r.p and r.strict == r.s for r in df.collect())


def test_junk_and_labels(spark):
    df = spark.createDataFrame([("https://social.com/ads/tracker",)], "u string")
    row = df.select(urls.is_junk(F.col("u"), ["social.com"]).alias("j"),
                    urls.is_junk(F.col("u"), []).alias("k"),
                    urls.node_label(F.col("u")).alias("l"),
                    urls.node_label(F.lit("QUERY: x")).alias("q"),
                    urls.node_label(F.lit("https://a.test")).alias("h"),
                    urls.display_label(F.lit("x" * 40)).alias("d")).first()
    assert (row.j, row.k) == (True, False)
    assert row.l == "social.com/ads/tracker..." and row.q == "QUERY: x" and row.h == "a.test"
    assert row.d == "x" * 32 + "..."
