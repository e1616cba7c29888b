import random

import pytest
from pyspark.sql import functions as F

from leadloom.config import HuntConfig
from leadloom.operators import graph as G, pages as P
from leadloom.operators.evaluate import evaluate_by_rules, evaluate_with_model
from leadloom.plans import crawl as C
from leadloom.schemas import LEAD_STORE

EN = "This is the page of a software company and it is in the city with that team for you. "


def page(url, text, *links):
    anchors = "".join(f'<a href="{h}">link</a> ' for h in links)
    return url, f"<html><body><p>{text}</p>{anchors}</body></html>"


# Two roots, four levels, a shared page, a junk link, a blank page, a foreign
# page, a page with six links, two converting siblings.
SITE = [
    page("https://one.test", EN, "/about", "/team", "/blog", "/contact-ru"),
    page("https://one.test/about", EN, "/team/a", "/team/b", "https://shared.test/about", "/blank/about",
         "https://junk.test/about", "/team/z"),
    page("https://one.test/team", EN, "/people/x", "/people/y"),
    page("https://one.test/contact-ru", "Der Hund ist nicht mit den Katzen und das ist die Software der Firma zu ein"),
    page("https://one.test/blank/about", ""),
    page("https://one.test/people/x", EN + "mail x@one.test"),
    page("https://one.test/people/y", EN + "mail y@one.test"),
    page("https://one.test/team/a", EN, "/team/deep"),
    page("https://one.test/team/deep", EN, "/team/deeper"),
    page("https://one.test/team/deeper", EN + "mail deep@one.test"),
    page("https://shared.test/about", EN, "/contact"),
    page("https://shared.test/contact", EN + "mail hello@shared.test"),
    page("https://two.test", EN, "https://shared.test/about/#top", "https://one.test/team"),
]


def run(spark, hits, site=SITE, visited=None, config=HuntConfig(junk_domains=("junk.test",)), evaluate=None):
    roots = spark.createDataFrame([(i, "q", h) for i, h in enumerate(hits)], "root_order long, query string, href string")
    pages = spark.createDataFrame(site, "url string, html string")
    observe = lambda df: P.observations(df.withColumn("html", F.coalesce("html", F.lit(""))), config)
    return C.crawl(roots, pages, observe, evaluate or (lambda df: evaluate_by_rules(df)), visited, config)


PAGE = "url string, html string"


def OBSERVE(df):
    return P.observations(df.withColumn("html", F.coalesce("html", F.lit(""))), HuntConfig())


def store_and_verdicts(spark):
    return spark.createDataFrame([], "email string"), spark.createDataFrame([], "email string, result string")


def settle(spark, result, known=()):
    store = spark.createDataFrame([(e,) for e in known], "email string")
    verdicts = spark.createDataFrame([], "email string, result string")
    return C.settle(result, store, verdicts)


@pytest.fixture(scope="module")
def hunt(spark):
    result = run(spark, ["https://one.test/", "https://two.test/#x"])
    return result, settle(spark, result)


def test_visits(hunt):
    result, _ = hunt
    rows = {r.url: r for r in result.visits.collect()}
    assert len(rows) == result.visits.count()
    assert max(r.depth for r in rows.values()) <= 3
    assert rows["https://one.test/about"].outcome == "FOLLOW"
    assert rows["https://one.test/contact-ru"].outcome == "blank"
    assert rows["https://one.test/blank/about"].outcome == "blank"
    assert rows["https://junk.test/about"].outcome == "junk"
    # The page with six links keeps the best four in (rank, url) order.
    children = {u for u, r in rows.items() if r.parent_id == "https://one.test/about"}
    assert children <= {"https://junk.test/about", "https://one.test/blank/about", "https://one.test/team/a",
                        "https://one.test/team/b", "https://shared.test/about"}
    assert "https://one.test/team/z" not in rows
    # Reached at depth 1 by root 1, so it belongs to that root.
    assert (rows["https://shared.test/about"].root_order, rows["https://shared.test/about"].depth) == (1, 1)
    assert rows["https://one.test/team"].root_order == 0
    ledger = rows["https://one.test/people/x"].ledger
    assert ledger[0].startswith("[0] https://one.test -> [Note: ") and ledger[-1] == "[2] https://one.test/people/x"


def test_leads_and_branches(hunt):
    result, outcome = hunt
    leads = {r.root_order: r.email for r in outcome.leads.collect()}
    assert leads == {0: "x@one.test", 1: "hello@shared.test"}
    states = {r.url: r.state for r in outcome.branches.collect()}
    assert states["https://one.test"] == states["https://one.test/team"] == "convert"
    assert states["https://one.test/about"] == "prune"
    funnel = {r.depth: r for r in C.funnel_by_depth(result).collect()}
    assert funnel[0].n_pages == 2 and sum(r.n_convert for r in funnel.values()) == 3
    per_query = C.leads_per_query(result, outcome.leads).first()
    assert (per_query.query, per_query.n_roots, per_query.n_leads) == ("q", 2, 2)


def test_events_and_graph(hunt):
    _, outcome = hunt
    events = outcome.events
    titles = {(r.node_id, r.title) for r in events.collect()}
    assert ("QUERY: q", "Search Engine Query") in titles
    assert ("https://junk.test/about", "Junk Domain Match") in titles
    assert ("https://one.test/team", "Visited or Depth Limit") in titles
    nodes = {r.node_id: r for r in G.graph_nodes(events).collect()}
    assert nodes["https://one.test"].state == "convert"
    assert nodes["https://one.test/people/y"].state == "pending"  # beyond the early exit
    edges = {(r.source, r.target) for r in G.graph_edges(events, G.graph_nodes(events)).collect()}
    assert ("QUERY: q", "https://one.test") in edges
    assert ("https://two.test", "https://one.test/team") in edges


def test_depth_limit_and_visited(spark):
    shallow = run(spark, ["https://one.test"], config=HuntConfig(max_depth=0))
    assert [r.url for r in shallow.visits.collect()] == ["https://one.test"]
    assert shallow.frontier.where("depth = 1 AND fresh").isEmpty()
    visited = spark.createDataFrame([("https://one.test",)], "url string").select(F.sha2("url", 256).alias("url_hash"))
    again = run(spark, ["https://one.test"], visited=visited)
    assert again.visits.isEmpty() and settle(spark, again).leads.isEmpty()


def test_missing_page_gives_no_lead(spark):
    result = run(spark, ["https://gone.test"])
    assert [r.outcome for r in result.visits.collect()] == ["blank"]
    assert settle(spark, result).leads.isEmpty()


def test_no_hits(spark):
    assert run(spark, []).visits.isEmpty()


def test_model_evaluator_and_stored_email(spark):
    def make_model():
        def answer(prompts):
            if any("broken.test" in p for p in prompts):
                raise RuntimeError("model is down")
            return ['{"decision": "CONVERT", "discovery_summary": "ok", "company": "AI Co", "email": "boss@ai.com"}'
                    for _ in prompts]
        return answer

    def evaluate(df):
        return evaluate_with_model(df, make_model, F.concat("url", F.lit("\n"), "text"))

    site = [page("https://ai.test", EN), page("https://broken.test", EN)]
    result = run(spark, ["https://ai.test"], site, evaluate=evaluate)
    lead = settle(spark, result).leads.first()
    assert (lead.email, lead.company) == ("boss@ai.com", "AI Co")
    known = settle(spark, result, ["boss@ai.com"])
    assert known.leads.isEmpty()
    assert not known.events.where("title = 'Already Contacted'").isEmpty()
    down = run(spark, ["https://broken.test"], site, evaluate=evaluate).visits.first()
    assert down.outcome == "PRUNE" and down.summary.startswith("Execution Error")


def test_a_failing_prompt_fails_alone(spark):
    def make_model():
        def answer(prompts):
            if "bad" in prompts:
                raise RuntimeError("no answer")
            return ['{"decision": "FOLLOW", "discovery_summary": "s", "next_target_urls": "[team](https://x.test/team)"}'] * len(prompts)
        return answer

    df = spark.createDataFrame([(n, "bad" if n == 7 else f"p{n}") for n in range(20)], "url long, p string").coalesce(1)
    got = {r.url: r.decision for r in evaluate_with_model(df, make_model, F.col("p")).collect()}
    assert [n for n, d in got.items() if d.decision == "PRUNE"] == [7]
    assert got[7].discovery_summary == "Execution Error: no answer"
    assert got[1].next_target_urls == ["[team](https://x.test/team)"]


def test_pages_beyond_an_exit_are_free_for_later_roots(spark):
    def convert(mail):
        return f'<p>AI software</p><a href="mailto:{mail}">m</a>'

    site = [page("https://a.test", EN + '<a href="https://a.test/about">contact</a><a href="https://s.test/team">contact team</a>'),
            page("https://b.test", EN + '<a href="https://s.test/team">contact team</a>'),
            page("https://a.test/about", "x"), page("https://s.test/team", "y")]

    def decide(df):
        text = {"https://a.test/about": "x@a.test", "https://s.test/team": "y@s.test"}
        mail = F.coalesce(*[F.when(F.col("url") == u, m) for u, m in text.items()])
        targets = F.when(F.col("url") == "https://a.test", F.array(F.lit("https://a.test/about"), F.lit("https://s.test/team"))).when(
            F.col("url") == "https://b.test", F.array(F.lit("https://s.test/team"))).otherwise(F.array().cast("array<string>"))
        return df.withColumn("decision", F.struct(
            F.when(mail.isNotNull(), "CONVERT").otherwise("FOLLOW").alias("decision"), F.lit("s").alias("discovery_summary"),
            targets.alias("next_target_urls"), F.lit("C").alias("company"), F.lit("P").alias("person"), mail.alias("email")))

    first = run(spark, ["https://a.test", "https://b.test"], site, evaluate=decide)
    pages = spark.createDataFrame(site, PAGE)
    result, outcome = C.settle_with_release(first, pages, OBSERVE, decide, *store_and_verdicts(spark))
    assert sorted((r.root_order, r.email) for r in outcome.leads.collect()) == [(0, "x@a.test"), (1, "y@s.test")]
    assert sorted(r.url for r in C.opened_visits(result, outcome.leads).collect()) == [
        "https://a.test", "https://a.test/about", "https://b.test", "https://s.test/team"]
    # Without the second root the page stays closed, and is not marked as visited.
    alone = run(spark, ["https://a.test"], site, evaluate=decide)
    result, outcome = C.settle_with_release(alone, pages, OBSERVE, decide, *store_and_verdicts(spark))
    assert "https://s.test/team" not in {r.url for r in C.opened_visits(result, outcome.leads).collect()}


def one_after_another(rows):
    taken, expected = set(), {}
    for root in sorted({r[0] for r in rows}):
        for _, path, email in sorted(r for r in rows if r[0] == root):
            if email not in taken or "NEEDS" in email:
                taken.add(email)
                expected[root] = (path, email)
                break
    return expected


def settled(spark, rows, **how):
    df = spark.createDataFrame(rows, "root_order long, order_path array<int>, email string")
    return {r.root_order: (r.order_path, r.email) for r in C.settle_leads(df, **how).collect()}


@pytest.mark.parametrize("most", [100_000, 6, 1])
def test_settling_equals_one_root_after_another(spark, most):
    rng = random.Random(7)
    rows = [(root, [leaf], rng.choice(["a", "b", "c", "d", "e", "NEEDS_ENRICHMENT@x"]))
            for root in range(12) for leaf in range(rng.randint(1, 4))]
    rows += [(root, [leaf], rng.choice([f"x{root // 3}", f"y{root // 2}", f"z{root}"])) for root in range(20, 50) for leaf in range(3)]
    assert settled(spark, rows, most=most) == one_after_another(rows)


def test_a_chain_of_refusals_needs_few_rounds(spark, monkeypatch):
    rows = [(0, [0], "e0")] + [(n, [k], f"e{n - 1 + k}") for n in range(1, 1000) for k in range(2)]
    writes = []
    monkeypatch.setattr(C, "write_scratch", lambda df, label, real=C.write_scratch: writes.append(label) or real(df, label))
    assert settled(spark, rows) == one_after_another(rows)
    assert len(writes) < 12


def test_connected_groups(spark):
    from leadloom.operators.groups import connected_groups

    links = [(n, n + 1) for n in range(100, 160)] + [(5, 3), (3, 5), (9, 9), (1, 7), (7, 2)] + [(1000, n) for n in range(900, 930)]
    got = connected_groups(spark.createDataFrame(links, "a long, b long")).collect()
    members = {}
    for r in got:
        members.setdefault(r.group, set()).add(r.node)
    assert sorted(map(sorted, members.values())) == [[1, 2, 7], [3, 5], [9], list(range(100, 161)), [*range(900, 930), 1000]]
    assert connected_groups(spark.createDataFrame([], "a long, b long")).count() == 0


def test_min_depth_tasks_go_by_rows(spark, tmp_path, monkeypatch):
    from leadloom.catalog import hunt

    items = [(i % 7, i % 23) for i in range(300)] + [(None, 5), (3, None), (None, None)]
    spark.createDataFrame(items, "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i, -1.0 if i == 2 else 1.0) for i in range(7)], "s_suppkey long, s_acctbal double").write.parquet(
        str(tmp_path / "supplier.parquet"))
    tasks, top = [], hunt.P.top_links

    def spied(links, *args, **more):
        tasks.append(links.select(F.spark_partition_id().alias("t")).distinct().count())
        return top(links, *args, **more)

    monkeypatch.setattr(hunt.P, "top_links", spied)
    monkeypatch.setattr(hunt, "PAIRS_PER_TASK", 2, raising=False)
    got = {r.url: r.depth for r in hunt.crawl_min_depth(spark, str(tmp_path)).collect()}
    links = {}
    for s, p in items:
        if s is not None and p is not None:
            links.setdefault(f"https://s{s}.test", set()).add(f"https://p{p}.test")
            links.setdefault(f"https://p{p}.test", set()).add(f"https://s{s}.test")
    depth = {"https://s2.test": 0}
    for d in range(3):
        for at in [u for u, x in depth.items() if x == d]:
            for to in sorted(links[at])[:4]:
                depth.setdefault(to, d + 1)
    assert got == depth
    assert tasks[0] > 30  # 164 pairs, two to a task: many tasks, however few bytes the pairs are
