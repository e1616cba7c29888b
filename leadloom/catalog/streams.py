"""Streaming queries, each run to the end of the available input."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.catalog.outreach import DELIVERY_SQL, MESSAGES, chat_messages, deliveries
from leadloom.catalog.registry import query
from leadloom.streaming import delivery, graph, leads, messages, runs, urls


def _stream(spark, sf, name):
    runs.use_rocksdb(spark)
    return runs.read_stream(spark, f"{sf.rstrip('/')}/{name}.parquet")


@query("stream_url_dedup", """
SELECT DISTINCT 'https://u' || user_id || '.test/' || event_type AS url, sha256('https://u' || user_id || '.test/' || event_type) AS url_hash FROM events""")
def stream_url_dedup(spark, sf):
    events = _stream(spark, sf, "events")
    seen = events.select("event_id", F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".test/"), "event_type").alias("url"))
    return runs.run_append(urls.first_sight(seen, "event_id").select("url", "url_hash"), "dedup")


def lead_events(events):
    """Purchases as found leads, one address per user and hour of the day."""
    hour = F.date_format("ts", "HH")
    return events.where("event_type = 'purchase'").select(
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("."), hour, F.lit("@mail.test")).alias("email"),
        F.concat(F.lit("Hour "), hour).alias("company_name"), F.lit(None).cast("string").alias("founder_name"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("reason"), F.col("ts").alias("date_found"), "event_id")


_LEADS = """
lead_events AS (SELECT 'user' || user_id || '.' || strftime(ts, '%H') || '@mail.test' AS email, 'Hour ' || strftime(ts, '%H') AS company_name,
    'Founder' AS founder_name, 'event ' || event_id AS reason, ts AS date_found, event_id FROM events WHERE event_type = 'purchase'),
store AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY date_found, event_id) AS rn FROM lead_events) WHERE rn = 1)"""


@query("stream_lead_sink", f"""WITH {_LEADS}
SELECT email, company_name, founder_name, reason, false AS contacted, false AS delivery_failed, date_found FROM store""")
def stream_lead_sink(spark, sf):
    store = leads.lead_sink(lead_events(_stream(spark, sf, "events")), ["date_found", "event_id"])
    return store.withColumn("date_found", F.col("date_found").cast("timestamp_ntz"))


@query("stream_delivery_state", DELIVERY_SQL)
def stream_delivery_state(spark, sf):
    changes = runs.run_batches(delivery.delivery_states(deliveries(_stream(spark, sf, "events"))), "delivery", mode="update")
    clock = {c: F.col(c).cast("timestamp_ntz") for c in ("decided_at", "retry_at")}
    return delivery.current_states(changes).withColumns(clock)


@query("stream_retry_due", """
WITH a AS (SELECT 'user' || user_id || '@mail.test' AS email, ts, event_type,
    CASE WHEN event_type = 'error' THEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) END AS soft
  FROM events WHERE event_type IN ('purchase', 'error', 'signup')),
e AS (SELECT email, min(ts) FILTER (WHERE event_type <> 'error' OR soft = 2) AS ended, min(ts) FILTER (WHERE soft = 1) AS failed_at FROM a GROUP BY email)
SELECT email, CAST(1 AS BIGINT) AS attempt, failed_at, failed_at + INTERVAL 60 SECOND AS due_at FROM e
WHERE failed_at + INTERVAL 60 SECOND <= (SELECT max(ts) FROM events) AND (ended IS NULL OR ended > failed_at + INTERVAL 60 SECOND)""")
def stream_retry_due(spark, sf):
    due = runs.run_append(delivery.retries_due(deliveries(_stream(spark, sf, "events"))), "retries")
    return due.select(F.col("key").alias("email"), "attempt", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("failed_at", "due_at")])


@query("stream_message_route", f"WITH {MESSAGES} SELECT command, count(*) AS n FROM routed GROUP BY command")
def stream_message_route(spark, sf):
    routed = messages.route_messages(chat_messages(_stream(spark, sf, "conversations")), "42")
    return runs.run_append(routed, "routed").groupBy("command").agg(F.count("*").alias("n"))


@query("stream_stats", """
SELECT count(*) AS total_leads, count(*) FILTER (WHERE c_acctbal >= 2000) AS uncontacted_leads FROM customer""")
def stream_stats(spark, sf):
    stored = _stream(spark, sf, "customer").select((F.col("c_acctbal") < 2000).alias("contacted"))
    return runs.last_batch(runs.run_batches(leads.live_stats(stored), "stats", mode="complete"))


@query("stream_graph_nodes", """
WITH e AS (SELECT *, lag(event_type || '|' || props) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
l AS (SELECT 'https://u' || user_id || '.test/feed' AS node_id, arg_max(event_type, event_id) AS kind, arg_max(props, event_id) AS props,
    count(*) FILTER (WHERE before IS NULL OR before <> event_type || '|' || props) AS n_updates, user_id FROM e GROUP BY user_id),
s AS (SELECT *, CASE kind WHEN 'purchase' THEN 'convert' WHEN 'error' THEN 'prune' WHEN 'signup' THEN 'skip' ELSE kind END AS state FROM l)
SELECT node_id, 'u' || user_id || '.test/feed...' AS label, state, CASE state WHEN 'convert' THEN '#32CD32' WHEN 'skip' THEN '#A9A9A9'
  ELSE '#FF4500' END AS colour, replace(props, '"', '&quot;') AS title, n_updates FROM s""")
def stream_graph_nodes(spark, sf):
    kind = F.col("event_type")
    state = (F.when(kind == "purchase", "convert").when(kind == "error", "prune").when(kind == "signup", "skip").otherwise(kind))
    events = _stream(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".test/feed")).alias("node_id"),
        state.alias("state"), F.col("props").alias("title"))
    return graph.live_nodes(events)
