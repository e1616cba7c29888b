from datetime import datetime

import pytest
from pyspark.sql import functions as F, types as T

from leadloom.functions import context, decisions as D, html as H
from leadloom.config import HuntConfig
from leadloom.operators import campaigns as K, evalset as V, graph as G, leads as L, outreach as O, pages as P, search as R
from leadloom.schemas import LEAD_STORE
from leadloom.sources import tables
from leadloom.sources.schema_sync import sync_schema, sync_table
from leadloom.streaming.messages import route_messages


def store(spark, *rows):
    return spark.createDataFrame([(e, "C", "F", "r", c, False, datetime(2026, 1, d)) for e, c, d in rows], LEAD_STORE)


@pytest.mark.parametrize("email", [None, "invalid-at-sign", ""])
def test_placeholder(spark, email):
    df = spark.createDataFrame([("u", "No Email Corp", None, email)], "url string, company string, person string, email string")
    none = spark.createDataFrame([], "email string, result string")
    out = L.build_leads(L.flag_for_enrichment(L.with_deliverability(L.clean_lead(df), none))).first()
    assert (out.email, out.founder_name, out.retry_count) == ("NEEDS_ENRICHMENT@noemailcorp.com", "N/A", 0)


def test_deliverability(spark):
    rows = [("a@x", None, True), ("b@x", "unknown", True), ("c@x", "invalid", False), ("d", "valid", False), (None, None, False)]
    df = spark.createDataFrame(rows, "email string, verdict string, e boolean")
    out = df.select("e", L.is_deliverable(F.col("email"), F.col("verdict")).alias("d")).collect()
    assert all(r.e == r.d for r in out)


def test_store(spark, tmp_path):
    known = store(spark, ("a@x", True, 1), ("b@x", False, 2), ("c@x", False, 1))
    new = spark.createDataFrame(
        [("n@x", "first", None, None, datetime(2026, 2, 1), 1), ("n@x", "second", "P", "why", datetime(2026, 2, 1), 2),
         ("a@x", "known", "P", "why", datetime(2026, 2, 1), 3)],
        "email string, company_name string, founder_name string, reason string, date_found timestamp, i int")
    rows = L.new_store_rows(new, known, ["date_found", "i"]).collect()
    assert [(r.email, r.company_name, r.founder_name, r.reason) for r in rows] == [("n@x", "first", "Founder", "No reason provided.")]
    path = str(tmp_path / "store")
    known.write.parquet(path)
    tables.append_leads(new, spark.read.schema(LEAD_STORE).parquet(path), path, ["date_found", "i"])
    tables.append_leads(new, spark.read.schema(LEAD_STORE).parquet(path), path, ["date_found", "i"])
    assert spark.read.parquet(path).count() == 4
    assert L.oldest_uncontacted(known).first().email == "c@x"
    assert L.random_uncontacted(known, seed=1).first().email in ("b@x", "c@x")
    updates = spark.createDataFrame([("b@x", "failed"), ("b@x", "contacted"), ("zz", "contacted")], "email string, status string")
    after = {r.email: (r.contacted, r.delivery_failed) for r in L.apply_status(known, updates).collect()}
    assert after == {"a@x": (True, False), "b@x": (True, True), "c@x": (False, False)}
    assert [r.email for r in L.rejected_updates(known, updates).collect()] == ["zz"]
    stats = L.hunt_stats(known, spark.createDataFrame([("h",)], "url_hash string")).first()
    assert (stats.total_leads, stats.uncontacted_leads, stats.visited_urls) == (3, 2, 1)
    assert tuple(L.hunt_stats(known.limit(0), spark.createDataFrame([], "url_hash string")).first()) == (0, 0, 0)


def test_stored_leads_are_skipped_but_placeholders_pass(spark):
    known = store(spark, ("a@x", False, 1), ("NEEDS_ENRICHMENT@c.com", False, 1))
    new = spark.createDataFrame([("a@x",), ("b@x",), ("NEEDS_ENRICHMENT@c.com",)], "email string")
    assert {r.email for r in L.not_yet_stored(new, known).collect()} == {"b@x", "NEEDS_ENRICHMENT@c.com"}
    assert L.not_yet_stored(new, known, only_contacted=True).count() == 3


def test_visited_append(spark, tmp_path):
    urls = spark.createDataFrame([("u1",), ("u1",), ("u2",)], "url string")
    path, at = str(tmp_path / "visited"), F.lit(datetime(2026, 1, 1))
    empty = spark.createDataFrame([], "url_hash string")
    assert tables.append_visited(urls, empty, path, at).count() == 2
    assert tables.append_visited(urls, spark.read.parquet(path), path, at).count() == 0


def test_schema_sync(spark, tmp_path):
    legacy = spark.createDataFrame([("e@x", "C", 5)], "email string, company_name string, extra int")
    target = T.StructType([*LEAD_STORE.fields, T.StructField("note", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()), False)])
    out = sync_schema(legacy, target, datetime(2026, 3, 1))
    assert out.columns[:3] == ["email", "company_name", "extra"]
    row = out.first()
    assert (row.founder_name, row.contacted, row.delivery_failed, row.date_found, row.note, row.tags) == (
        "", False, False, datetime(2026, 3, 1), None, None)
    old, new = str(tmp_path / "v1"), str(tmp_path / "v2")
    legacy.write.parquet(old)
    assert "reason" in sync_table(spark, old, LEAD_STORE, new).columns
    assert "reason" not in spark.read.parquet(old).columns
    with pytest.raises(ValueError):
        sync_table(spark, old, LEAD_STORE, old)


def test_decisions(spark):
    good = '{"decision": "CONVERT", "discovery_summary": "s", "email": "a@x"}'
    rows = [good, '{"decision": "PRUNE", "discovery_summary": "s"}', "{broken", '{"decision": "convert", "discovery_summary": "s"}',
            '{"decision": "FOLLOW", "discovery_summary": "s", "next_target_urls": ["/a", "", null]}',
            '{"decision": "FOLLOW", "discovery_summary": "s", "next_target_urls": "/b"}']
    out = [r.d for r in spark.createDataFrame([(r,) for r in rows], "j string").select(D.parse_decision(F.col("j")).alias("d")).collect()]
    assert (out[0].decision, out[0].email, out[0].company) == ("CONVERT", "a@x", "Unknown")
    assert (out[1].company, out[1].next_target_urls) == ("Unknown", [])
    assert all(o.decision == "PRUNE" and o.discovery_summary.startswith("Execution Error") and o.email is None for o in out[2:4])
    assert (out[4].next_target_urls, out[5].next_target_urls) == (["/a"], ["/b"])


def test_page_parts(spark):
    html = ('<html><head><title>T</title></head><body>Hi <!-- <script> --> there<script>var a="</p>";</script><p>A &amp; B<br>c '
            '<a class=x href="/con&amp;tact/#f"><b>Con</b>tact &lt;1&gt;</a> <a href="">none</a> <a href="x.html"> </a> <a name=q>plain</a>'
            '<p>a@b.png a@example.com u00x@c.io ok@c.io OK2@c.io <a href="mailto:Q@Z.io">mail</a> it is the end of that and</body></html>')
    row = P.observations(spark.createDataFrame([("https://h.test/d/e", html)], "url string, html string")).first()
    assert row.emails == ["OK2@c.io", "Q@Z.io", "ok@c.io"]
    assert row.links == ["https://h.test/con&tact", "https://h.test/d/x.html", "mailto:Q@Z.io"]
    assert row.status == "ok" and row.text.startswith("--- HIGH CONFIDENCE EMAILS FOUND ON PAGE: OK2@c.io, Q@Z.io, ok@c.io ---\n\nHi there\nA & B\nc ")
    assert "[Contact <1>](https://h.test/con&tact/#f) none plain\n" in row.text
    cut = P.observations(spark.createDataFrame([("https://h.test", "<p>\U0001F600ab cd</p>")], "url string, html string"),
                         HuntConfig(max_observation_chars=2)).first()
    assert cut.text == "\U0001F600a" and cut.language is None
    blank = P.observations(spark.createDataFrame([("https://h.test", "<script>x")], "url string, html string")).first()
    assert (blank.status, blank.text) == ("blank", "")


def test_email_scan_equals_plain_pattern(spark):
    import re
    from leadloom.config import EMAIL_PATTERN
    texts = ["a@b.com%x@c.org", "a@b.co-x@y.com", "a@b.com@d.org", "aaaa%%@@b.co x@y.z1 ..a@b.cc.", "@b.com a@b", "é@x.com aé@x.com"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", H.all_emails(F.col("t")).alias("e"))
    for r in df.collect():
        assert r.e == sorted(set(re.findall(EMAIL_PATTERN, r.t)))


def test_path_context(spark):
    ledger = F.array(F.lit("[0] a"), F.lit("[1] b"))
    row = spark.range(1).select(context.path_context(ledger, 0).alias("all"), context.path_context(ledger, 3).alias("cut"),
                                context.annotate_last(ledger, F.lit("n")).alias("n")).first()
    assert (row["all"], row.cut, row.n) == ("[0] a\n[1] b", "] b", ["[0] a", "[1] b -> [Note: n]"])


def test_search(spark):
    hits = [("q", i, f"https://h{i}.ru/" if i < 6 else f"https://h{i}.test/") for i in range(1, 9)]
    out = R.search_topn(spark.createDataFrame(hits, "query string, position long, href string"), 2).collect()
    assert [r.position for r in out] == [6]
    docs = spark.createDataFrame([(1, "Red apple pie, red apple"), (2, "a pineapple and red things"), (3, "apple. Red apple!")],
                                 "doc_id long, text string")
    queries = R.parse_boolean_query(spark.createDataFrame([(1, '"red apple"'), (2, '"apple" AND "pie"'), (3, "none"), (4, '"zzz"'), (5, "Pie apple")],
                                                          "query_id long, query string"))
    got = sorted((r.query_id, r.position, r.doc_id, r.score) for r in R.corpus_search(queries, docs).collect())
    assert [g for g in got if g[0] < 5] == [(1, 1, 1, 2), (1, 2, 3, 1), (2, 1, 1, 3)]
    assert {g[0] for g in got} == {1, 2, 5}  # plain words are searched as well


def test_campaigns(spark):
    df = spark.createDataFrame([(1, "In {locations}", ["Oslo", "Bonn"]), (2, "In {locations}", [])],
                               "campaign_id long, intent string, locations array<string>")
    assert [r.intent for r in K.campaign_intent(df).orderBy("campaign_id").collect()] == ["In Oslo, Bonn", "In Global / Remote"]
    queries = K.campaign_queries(df, [("a", 4, ("p", "q")), ("b", 3, ("r",)), ("c", 3, ("s",))], ("d", "e"))
    assert {r.category: r["count"] for r in queries.groupBy("category").count().collect()} == {
        "a": 4, "b": 3, "c": 3}
    checked = {r.campaign_id: r for r in K.check_query_sets(K.with_fallback_query(df, queries)).collect()}
    assert checked[1].passed and checked[1].n_queries == 10
    assert not checked[2].passed and checked[2].n_queries == 1


def test_render(spark):
    df = spark.createDataFrame([("{company_name}", "X"), (None, "")], "founder_name string, company_name string")
    assert [r.body for r in O.render_outreach(df, "{founder_name} at {company_name}").collect()] == [
        "{company_name} at X", "Founder at your company"]
    with pytest.raises(ValueError):
        O.render_outreach(df, "{surname}")


def test_graph(spark):
    events = spark.createDataFrame([(1, "https://a.test/x", "pending", "<t>", None), (2, "https://a.test/x", "pending", "<t>", None),
                                    (3, "https://a.test/x", "odd", "", "QUERY: q"), (4, "QUERY: q", "query", "s", None),
                                    (5, "https://a.test/x", "odd", "", "https://gone.test")],
                                   "seq long, node_id string, state string, title string, parent_id string")
    nodes = {r.node_id: r for r in G.graph_nodes(events).collect()}
    assert (nodes["https://a.test/x"].colour, nodes["https://a.test/x"].title) == ("#FF4500", "https://a.test/x")
    assert [(r.source, r.target) for r in G.graph_edges(events, G.graph_nodes(events)).collect()] == [("QUERY: q", "https://a.test/x")]
    assert [r.seq for r in G.state_changes(events, pieces=3).orderBy("seq").collect()] == [1, 3, 4]


def test_evalset(spark):
    gold = spark.createDataFrame([("a", "CONVERT"), ("b", "FOLLOW"), ("c", "PRUNE"), ("d", "PRUNE")], "url string, decision string")
    pred = spark.createDataFrame([(c, u, d) for c, ds in enumerate(["CPPP", "CFPC", "CFPC"]) for u, d in zip(
        "abcd", [{"C": " convert ", "F": "Follow", "P": "PRUNE"}[x] for x in ds])], "candidate long, url string, decision string")
    accuracy = V.decision_accuracy(pred, gold)
    assert {r.candidate: r.accuracy for r in accuracy.collect()} == {0: 0.75, 1: 0.75, 2: 0.75}
    assert V.best_candidate(accuracy).first().candidate == 0
    assert {r.url for r in V.train_split(gold).where("split = 'train'").collect()} == {"a", "b", "c"}
    assert V.select_demos(pred, gold, max_demos=2).count() == 6


def test_messages(spark):
    rows = [(" 2 ", "42", "stats"), ("a@b.co", "42", "custom_test"), ("9", "42", "menu"), ("1", "7", "unauthorised"), (None, "42", "ignored")]
    df = spark.createDataFrame(rows, "text string, chat_id string, e string")
    assert all(r.e == r.command for r in route_messages(df, "42").collect())
