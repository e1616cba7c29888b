"""Decisions, lead clean-up, lead store and statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from leadloom.catalog import sql as S
from leadloom.catalog.registry import query
from leadloom.catalog.web import SUFFIXES, OBSERVED_SQL
from leadloom.functions import decisions as D
from leadloom.functions.patterns import any_of
from leadloom.operators import evaluate as E, leads as L, pages as P
from leadloom.schemas import LEAD_STORE
from leadloom.sources.schema_sync import sync_schema
from leadloom.sources.tables import read_for_parsing, read_table

TOPIC, OFF_TOPIC = ("thion", "oner", "eder", "shat"), ("reand", "theth")


# --- shared inputs, built from the given tables -----------------------------

def lead_store(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as stored leads, found on the day of their first order."""
    first = read_table(spark, sf, "orders", ["o_custkey", "o_orderdate"]).groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first_order"))
    c = read_table(spark, sf, "customer").join(first, F.col("o_custkey") == F.col("c_custkey"), "left")
    return c.select(
        customer_email().alias("email"), F.concat("c_mktsegment", F.lit(" Co")).alias("company_name"),
        F.col("c_name").alias("founder_name"), F.concat(F.lit("segment "), "c_mktsegment").alias("reason"),
        (F.col("c_acctbal") < 2000).alias("contacted"), (F.col("c_acctbal") < 0).alias("delivery_failed"),
        F.coalesce("first_order", F.expr("TIMESTAMP_NTZ '1992-01-01 00:00:00'")).alias("date_found"),
        "c_nationkey", "c_custkey", "c_acctbal")


def customer_email():
    return F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@mail"),
                    F.col("c_nationkey").cast("string"), F.lit(".test"))


def converted(spark: SparkSession, sf: str) -> DataFrame:
    """One raw converted page per order; the e-mail is spoilt in some of them."""
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"]).join(
        read_table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    kind = F.left("o_orderpriority", F.lit(1))
    email = (F.when(kind == "1", customer_email()).when(kind == "2", F.concat(F.lit("  "), customer_email(), F.lit(" ")))
             .when(kind == "3", F.lit(None)).when(kind == "4", "invalid-at-sign").otherwise(F.lit("")))
    company = F.when(kind == "5", F.lit(None)).otherwise(F.concat(F.lit(" "), F.initcap("c_mktsegment"), F.lit(" Works")))
    return o.select("o_orderkey", "o_orderdate", F.concat(F.lit("https://order"), F.col("o_orderkey").cast("string"),
                    F.lit(".test/about")).alias("url"), company.alias("company"),
                    F.col("c_name").alias("person"), email.alias("email"))


CONVERTED = """
converted AS (SELECT o_orderkey, o_orderdate, 'https://order' || o_orderkey || '.test/about' AS url,
    CASE WHEN left(o_orderpriority, 1) = '5' THEN NULL
         ELSE ' ' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' Works' END AS company, c_name AS person,
    CASE left(o_orderpriority, 1) WHEN '1' THEN e WHEN '2' THEN '  ' || e || ' ' WHEN '3' THEN NULL
         WHEN '4' THEN 'invalid-at-sign' ELSE '' END AS email
  FROM (SELECT *, lower(replace(c_name, '#', '.')) || '@mail' || c_nationkey || '.test' AS e FROM orders
        JOIN customer ON o_custkey = c_custkey)),
clean AS (SELECT o_orderkey, o_orderdate, url, trim(coalesce(company, 'N/A')) AS company, trim(coalesce(person, 'N/A')) AS person,
          trim(coalesce(email, '')) AS email FROM converted)"""


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer").where("c_acctbal < 6000")
    result = F.when(F.col("c_acctbal") < 0, "invalid").when(F.col("c_acctbal") < 3000, "valid").otherwise("unknown")
    return c.select(customer_email().alias("email"), result.alias("result"))


VERDICTS = """
verdicts AS (SELECT lower(replace(c_name, '#', '.')) || '@mail' || c_nationkey || '.test' AS email,
    CASE WHEN c_acctbal < 0 THEN 'invalid' WHEN c_acctbal < 3000 THEN 'valid' ELSE 'unknown' END AS result
  FROM customer WHERE c_acctbal < 6000)"""

FLAGGED = f"""{CONVERTED}, {VERDICTS},
judged AS (SELECT clean.*, contains(clean.email, '@') AND coalesce(result, 'unknown') <> 'invalid' AS deliverable
           FROM clean LEFT JOIN verdicts ON clean.email = verdicts.email),
flagged AS (SELECT o_orderkey, o_orderdate, url, company, person, CASE WHEN deliverable THEN email
            ELSE 'NEEDS_ENRICHMENT@' || lower(replace(company, ' ', '')) || '.com' END AS email FROM judged)"""


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    judged = L.with_deliverability(L.clean_lead(converted(spark, sf)), verdicts(spark, sf))
    return L.flag_for_enrichment(judged)


# --- decisions ---------------------------------------------------------------

_KINDS = 8
_JSON_SQL = f"""
answers AS (SELECT doc_id, CASE doc_id % {_KINDS}
    WHEN 0 THEN '{{"decision": "CONVERT", "discovery_summary": "found ' || source || '", "company": "' || source || ' Ltd", "email": "info@' || source || '.test"}}'
    WHEN 1 THEN '{{"decision": "FOLLOW", "discovery_summary": "links", "next_target_urls": ["/about", "", "/team/' || doc_id || '"]}}'
    WHEN 2 THEN '{{"decision": "FOLLOW", "discovery_summary": "one link", "next_target_urls": "/contact"}}'
    WHEN 3 THEN '{{"decision": "PRUNE", "discovery_summary": "' || lang || '"}}'
    WHEN 4 THEN '{{"decision": "MAYBE", "discovery_summary": "x", "email": "a@b.test"}}'
    WHEN 5 THEN '{{"decision": "CONVERT", "email": "a@b.test"}}'
    WHEN 6 THEN 'no json ' || doc_id
    ELSE '{{"decision": "CONVERT", "discovery_summary": "no mail", "person": "P ' || doc_id || '", "email": null, "reason": "FREELANCE"}}'
    END AS answer FROM documents)"""
_PARSED_SQL = f"""{_JSON_SQL},
fields AS (SELECT doc_id, CASE WHEN json_valid(answer) THEN answer ELSE '{{}}' END AS j FROM answers),
opened AS (SELECT doc_id, j, j->>'$.decision' AS d, j->>'$.discovery_summary' AS s FROM fields),
parsed AS (SELECT doc_id, coalesce(d IN ('CONVERT', 'FOLLOW', 'PRUNE') AND s IS NOT NULL, false) AS valid, d, s, j,
    json_type(j, '$.next_target_urls') AS kind FROM opened),
decided AS (SELECT doc_id, CASE WHEN valid THEN d ELSE 'PRUNE' END AS decision,
    CASE WHEN valid THEN s ELSE 'Execution Error: ' || (CASE WHEN d IS NULL AND s IS NULL THEN 'unreadable decision'
      WHEN s IS NULL THEN 'summary is missing' ELSE 'decision is not one of CONVERT, FOLLOW, PRUNE' END) END AS discovery_summary,
    CASE WHEN NOT valid THEN [] WHEN kind = 'ARRAY' THEN list_filter(from_json(j->'$.next_target_urls', '["VARCHAR"]'), lambda u: u <> '')
      WHEN kind = 'VARCHAR' THEN [j->>'$.next_target_urls'] ELSE [] END AS targets,
    CASE WHEN valid THEN coalesce(j->>'$.company', 'Unknown') END AS company,
    CASE WHEN valid THEN coalesce(j->>'$.person', 'Unknown') END AS person,
    CASE WHEN valid THEN j->>'$.email' END AS email, CASE WHEN valid THEN coalesce(j->>'$.reason', '') END AS reason FROM parsed)"""


def answers(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents", ["doc_id", "source", "lang"])
    kind, text = F.col("doc_id") % _KINDS, F.col("doc_id").cast("string")
    return docs.select(
        "doc_id",
        F.when(kind == 0, F.format_string(
            '{"decision": "CONVERT", "discovery_summary": "found %s", "company": "%s Ltd", "email": "info@%s.test"}',
            "source", "source", "source"))
        .when(kind == 1, F.format_string(
            '{"decision": "FOLLOW", "discovery_summary": "links", "next_target_urls": ["/about", "", "/team/%s"]}', text))
        .when(kind == 2, '{"decision": "FOLLOW", "discovery_summary": "one link", "next_target_urls": "/contact"}')
        .when(kind == 3, F.format_string('{"decision": "PRUNE", "discovery_summary": "%s"}', "lang"))
        .when(kind == 4, '{"decision": "MAYBE", "discovery_summary": "x", "email": "a@b.test"}')
        .when(kind == 5, '{"decision": "CONVERT", "email": "a@b.test"}')
        .when(kind == 6, F.concat(F.lit("no json "), text))
        .otherwise(F.format_string(
            '{"decision": "CONVERT", "discovery_summary": "no mail", "person": "P %s", "email": null, "reason": "FREELANCE"}',
            text)).alias("answer"))


@query("decision_parse", f"""WITH {_PARSED_SQL} SELECT doc_id, decision, discovery_summary,
  array_to_string(targets, ' ') AS targets, company, person, email, reason FROM decided""")
def decision_parse(spark, sf):
    parsed = answers(spark, sf).select("doc_id", D.parse_decision(F.col("answer")).alias("d"))
    return parsed.select("doc_id", "d.decision", "d.discovery_summary",
                         F.array_join("d.next_target_urls", " ").alias("targets"), "d.company", "d.person", "d.email", "d.reason")


@query("decision_route", f"""WITH {_JSON_SQL}, r AS (SELECT doc_id, CASE WHEN json_valid(answer) THEN answer ELSE '{{}}' END AS j FROM answers)
SELECT doc_id, CASE WHEN j->>'$.decision' IN ('FOLLOW', 'CONVERT') THEN j->>'$.decision' ELSE 'PRUNE' END AS route,
       coalesce(j->>'$.discovery_summary', 'No summary provided') AS summary FROM r""")
def decision_route(spark, sf):
    raw = answers(spark, sf).select("doc_id", F.from_json("answer", "decision string, discovery_summary string").alias("d"))
    return raw.select("doc_id", D.route(F.col("d.decision")).alias("route"),
                      D.summary_or_default(F.col("d.discovery_summary")).alias("summary"))


@query("evaluate_rules", f"""
WITH {OBSERVED_SQL},
facts AS (SELECT page_id, emails, CASE WHEN status = 'ok' THEN body ELSE '' END AS text FROM observed),
rules AS (SELECT page_id, emails, coalesce({S.matches('lower(text)', any_of(TOPIC))}, false) AS topic,
                 {S.matches('lower(text)', any_of(OFF_TOPIC))} AS off FROM facts),
links AS (SELECT page_id, count(DISTINCT url) AS n FROM (SELECT page_id, {S.rooted_url('url', S.anchor_href('f'))} AS url
   FROM (SELECT page_id, url, unnest(regexp_extract_all({S.remove_noise('html')}, '(?is)<a\\s[^>]*>.*?</a\\s*>')) AS f FROM pages))
   WHERE {S.matches('lower(url)', any_of(('/the', '/and', '/of')))} GROUP BY page_id),
decided AS (SELECT rules.page_id, emails, coalesce(n, 0) AS n, CASE WHEN off OR NOT topic THEN 'PRUNE' WHEN len(emails) > 0 THEN 'CONVERT'
   WHEN coalesce(n, 0) > 0 THEN 'FOLLOW' ELSE 'PRUNE' END AS decision,
   CASE WHEN off THEN 'off-topic page' WHEN NOT topic THEN 'no topic match' WHEN len(emails) > 0 THEN 'topic match with e-mail'
   WHEN coalesce(n, 0) > 0 THEN 'topic match, contact link visible' ELSE 'topic match without contact' END AS summary
   FROM rules LEFT JOIN links ON rules.page_id = links.page_id)
SELECT page_id, decision, summary, CASE WHEN decision = 'FOLLOW' THEN n ELSE 0 END AS n_targets,
       CASE WHEN decision = 'CONVERT' THEN emails[1] END AS email FROM decided""")
def evaluate_rules(spark, sf):
    from leadloom.catalog.web import HIGH, LOW

    pages = read_for_parsing(spark, sf, "pages")
    decided = E.evaluate_by_rules(P.observations(pages, ignored_suffixes=SUFFIXES), topic_words=TOPIC, off_topic_words=OFF_TOPIC, high=HIGH, low=LOW)
    return decided.select("page_id", "decision.decision", F.col("decision.discovery_summary").alias("summary"),
                          F.size("decision.next_target_urls").cast("bigint").alias("n_targets"), "decision.email")


# --- leads -------------------------------------------------------------------

@query("lead_clean", f"WITH {CONVERTED} SELECT o_orderkey, url, company, person, email FROM clean")
def lead_clean(spark, sf):
    return L.clean_lead(converted(spark, sf)).select("o_orderkey", "url", "company", "person", "email")


@query("email_deliverable", f"""WITH {FLAGGED}
SELECT o_orderkey, email, deliverable, contains(email, '@') AS unverified FROM judged""")
def email_deliverable(spark, sf):
    judged = L.with_deliverability(L.clean_lead(converted(spark, sf)), verdicts(spark, sf))
    return judged.select("o_orderkey", "email", "deliverable",
                         L.is_deliverable(F.col("email"), F.col("verdict"), verification=False).alias("unverified"))


@query("lead_enrichment_flag", f"WITH {FLAGGED} SELECT o_orderkey, company, email FROM flagged")
def lead_enrichment_flag(spark, sf):
    return flagged(spark, sf).select("o_orderkey", "company", "email")


@query("lead_not_contacted", f"""WITH {FLAGGED}, {S.LEAD_STORE},
known AS (SELECT email FROM lead_store WHERE c_acctbal > 4000)
SELECT o_orderkey, email FROM flagged WHERE email NOT IN (SELECT email FROM known) OR contains(email, 'NEEDS_ENRICHMENT')""")
def lead_not_contacted(spark, sf):
    known = lead_store(spark, sf).where("c_acctbal > 4000")
    return L.not_yet_stored(flagged(spark, sf), known).select("o_orderkey", "email")


@query("lead_build", f"""WITH {FLAGGED}
SELECT url, company AS company_name, person AS founder_name, email, true AS is_qualified, CAST(NULL AS VARCHAR) AS drafted_email,
       CAST(0 AS INTEGER) AS retry_count FROM flagged""")
def lead_build(spark, sf):
    return L.build_leads(flagged(spark, sf))


def incoming(spark: SparkSession, sf: str) -> DataFrame:
    return flagged(spark, sf).select(
        "email", F.col("company").alias("company_name"), F.col("person").alias("founder_name"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("reason"),
        F.col("o_orderdate").alias("date_found"), "o_orderkey")


INCOMING = f"""{FLAGGED},
incoming AS (SELECT email, company AS company_name, person AS founder_name, 'order ' || o_orderkey AS reason,
             o_orderdate AS date_found, o_orderkey FROM flagged),
first_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY date_found, o_orderkey) AS rn
               FROM incoming) WHERE rn = 1)"""
_NEW_ROW = "email, company_name, founder_name, reason, false AS contacted, false AS delivery_failed, date_found"


@query("lead_insert_ignore", f"""WITH {INCOMING}, {S.LEAD_STORE}
SELECT {_NEW_ROW} FROM first_rows WHERE email NOT IN (SELECT email FROM lead_store WHERE c_acctbal > 4000)""")
def lead_insert_ignore(spark, sf):
    known = lead_store(spark, sf).where("c_acctbal > 4000")
    return L.new_store_rows(incoming(spark, sf), known, ["date_found", "o_orderkey"])


def updates(spark: SparkSession, sf: str) -> DataFrame:
    """Delivery results per order; those of suppliers are unknown to the store."""
    o = read_table(spark, sf, "orders", ["o_custkey", "o_orderstatus"]).where("o_orderstatus <> 'O'")
    sent = o.join(read_table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        customer_email().alias("email"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("contacted").alias("status"))
    strange = read_table(spark, sf, "supplier").select(
        F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("."))), F.lit("@x.test")).alias("email"),
        F.lit("contacted").alias("status"))
    return sent.unionByName(strange)


UPDATES = f"""{S.LEAD_STORE},
updates AS (SELECT lower(replace(c_name, '#', '.')) || '@mail' || c_nationkey || '.test' AS email,
     CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'contacted' END AS status
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'O'
  UNION ALL SELECT lower(replace(s_name, '#', '.')) || '@x.test', 'contacted' FROM supplier)"""


@query("lead_status_update", f"""WITH {UPDATES},
u AS (SELECT email, bool_or(status = 'failed') AS failed FROM updates GROUP BY email)
SELECT s.email, contacted OR failed IS NOT NULL AS contacted, delivery_failed OR coalesce(failed, false) AS delivery_failed
FROM lead_store s LEFT JOIN u ON s.email = u.email""")
def lead_status_update(spark, sf):
    changed = L.apply_status(lead_store(spark, sf), updates(spark, sf))
    return changed.select("email", "contacted", "delivery_failed")


@query("lead_status_rejects", f"WITH {UPDATES} SELECT email, status FROM updates WHERE email NOT IN (SELECT email FROM lead_store)")
def lead_status_rejects(spark, sf):
    return L.rejected_updates(lead_store(spark, sf), updates(spark, sf)).select("email", "status")


@query("hunt_stats", f"""WITH {S.LEAD_STORE}
SELECT count(*) AS total_leads, count(*) FILTER (WHERE NOT contacted) AS uncontacted_leads,
       (SELECT count(DISTINCT sha256(url)) FROM pages) AS visited_urls FROM lead_store""")
def hunt_stats(spark, sf):
    visited = read_table(spark, sf, "pages", ["url"]).select(F.sha2("url", 256).alias("url_hash")).distinct()
    return L.hunt_stats(lead_store(spark, sf), visited)


@query("oldest_uncontacted", f"""WITH {S.LEAD_STORE}
SELECT email, company_name, founder_name, date_found FROM lead_store WHERE NOT contacted ORDER BY date_found, email LIMIT 1""")
def oldest_uncontacted(spark, sf):
    return L.oldest_uncontacted(lead_store(spark, sf)).select("email", "company_name", "founder_name", "date_found")


@query("random_uncontacted", f"""WITH {S.LEAD_STORE}
SELECT email, company_name FROM lead_store WHERE NOT contacted ORDER BY {S.key_hash('email')}, email LIMIT 1""")
def random_uncontacted(spark, sf):
    return L.random_uncontacted(lead_store(spark, sf)).select("email", "company_name")


_SYNCED = T.StructType([*[f for f in LEAD_STORE.fields if f.name != "date_found"],
                        T.StructField("date_found", T.TimestampNTZType(), False),
                        T.StructField("score", T.DoubleType(), False), T.StructField("attempts", T.LongType(), False),
                        T.StructField("last_seen", T.DateType(), False), T.StructField("note", T.StringType(), True)])


@query("schema_sync", f"""WITH {S.LEAD_STORE}
SELECT email, company_name, '' AS founder_name, '' AS reason, false AS contacted, false AS delivery_failed,
  TIMESTAMP '2026-03-15 00:00:00' AS date_found, CAST(0 AS DOUBLE) AS score, CAST(0 AS BIGINT) AS attempts,
  DATE '2026-03-15' AS last_seen, CAST(NULL AS VARCHAR) AS note FROM lead_store""")
def schema_sync(spark, sf):
    legacy = lead_store(spark, sf).select("email", "company_name")
    return sync_schema(legacy, _SYNCED, datetime(2026, 3, 15))
