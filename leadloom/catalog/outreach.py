"""Outreach: messages, schedule, delivery, replacements, chat commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.catalog import sql as S
from leadloom.catalog.leads import FLAGGED, flagged, lead_store
from leadloom.catalog.registry import query
from leadloom.operators import outreach as O
from leadloom.sources.tables import messages_from, next_offsets, read_table
from leadloom.streaming.messages import route_messages

TEMPLATE = "Hi {founder_name},\nhow is work at {company_name}? Would {company_name} like to talk?\n"


@query("outreach_render", f"""WITH {S.LEAD_STORE},
l AS (SELECT email, CASE WHEN contacted THEN '' ELSE founder_name END AS founder_name,
      CASE WHEN delivery_failed THEN NULL ELSE company_name END AS company_name FROM lead_store),
n AS (SELECT email, coalesce(nullif(founder_name, ''), 'Founder') AS f, coalesce(nullif(company_name, ''), 'your company') AS c FROM l)
SELECT email, 'Hi ' || f || ',' || chr(10) || 'how is work at ' || c || '? Would ' || c || ' like to talk?' || chr(10) AS body FROM n""")
def outreach_render(spark, sf):
    leads = lead_store(spark, sf).select(
        "email", F.when(F.col("contacted"), "").otherwise(F.col("founder_name")).alias("founder_name"),
        F.when(~F.col("delivery_failed"), F.col("company_name")).alias("company_name"))
    return O.render_outreach(leads, TEMPLATE).select("email", "body")


@query("notification_render", f"""WITH {S.LEAD_STORE}
SELECT email, '<b>Outreach Sent Successfully!</b>' || chr(10) || chr(10) || '<b>Contact:</b> ' || email || chr(10) ||
  '<b>Company:</b> ' || company_name || chr(10) || '<b>Name:</b> ' || founder_name || chr(10) AS message
FROM lead_store WHERE contacted AND NOT delivery_failed""")
def notification_render(spark, sf):
    sent = lead_store(spark, sf).where("contacted AND NOT delivery_failed")
    return sent.select("email", O.notification(F.col("email"), F.col("company_name"), F.col("founder_name")).alias("message"))


@query("outreach_backlog", f"""WITH {FLAGGED}, {S.LEAD_STORE}
SELECT '' AS url, email, company_name, founder_name, 'backlog' AS source, CAST(0 AS BIGINT) AS queue_group FROM
  (SELECT * FROM lead_store WHERE NOT contacted ORDER BY date_found, email LIMIT 1)
UNION ALL SELECT url, email, company, person, 'new', CAST(1 AS BIGINT) FROM flagged""")
def outreach_backlog(spark, sf):
    new = flagged(spark, sf).select("url", "email", F.col("company").alias("company_name"),
                                    F.col("person").alias("founder_name"))
    return O.outreach_backlog(lead_store(spark, sf), new)


@query("send_schedule", f"""WITH {FLAGGED},
l AS (SELECT 'sender ' || company AS sender, email, o_orderkey, o_orderdate FROM flagged),
k AS (SELECT sender, email || '#' || o_orderkey AS email, o_orderdate FROM l WHERE NOT contains(email, 'NEEDS_ENRICHMENT')),
g AS (SELECT *, {S.key_hash('email')} AS h FROM k)
SELECT sender, email, 720 + h % 361 AS gap_sec, CAST(coalesce(sum(720 + h % 361) OVER (PARTITION BY sender
  ORDER BY CAST(epoch(o_orderdate) AS BIGINT) * 1048576 + (h >> 12), email ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
  AS send_offset_sec FROM g""")
def send_schedule(spark, sf):
    leads = flagged(spark, sf).select(
        F.concat(F.lit("sender "), "company").alias("sender"), F.col("o_orderdate").alias("date_found"),
        F.concat("email", F.lit("#"), F.col("o_orderkey").cast("string")).alias("email"))
    return O.send_schedule(leads).select("sender", "email", "gap_sec", "send_offset_sec")


def deliveries(events):
    """Events as delivery attempts: purchase ok, error soft_fail, signup hard_bounce."""
    outcome = (F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "soft_fail")
               .when(F.col("event_type") == "signup", "hard_bounce"))
    return events.select(F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@mail.test")).alias("email"),
                         "ts", "event_id", outcome.alias("outcome"))


DELIVERY_SQL = """
WITH a AS (SELECT 'user' || user_id || '@mail.test' AS email, ts, event_id, CASE event_type WHEN 'purchase' THEN 'ok'
             WHEN 'error' THEN 'soft_fail' ELSE 'hard_bounce' END AS outcome FROM events
           WHERE event_type IN ('purchase', 'error', 'signup')),
n AS (SELECT *, sum(CASE WHEN outcome = 'soft_fail' THEN 1 ELSE 0 END) OVER (PARTITION BY email ORDER BY ts, event_id) AS softs FROM a),
e AS (SELECT *, outcome IN ('ok', 'hard_bounce') OR softs > 1 AS terminal FROM n),
t AS (SELECT email, min(ts) AS decided_at, arg_min(outcome, (ts, event_id)) AS last FROM e WHERE terminal GROUP BY email),
r AS (SELECT e.email, count(*) FILTER (WHERE outcome = 'soft_fail' AND NOT terminal AND (decided_at IS NULL OR ts <= decided_at)) AS retry_count,
       max(ts) FILTER (WHERE outcome = 'soft_fail' AND NOT terminal) AS last_soft
      FROM e LEFT JOIN t ON e.email = t.email GROUP BY e.email)
SELECT r.email, CASE WHEN decided_at IS NULL THEN 'retry' WHEN last = 'ok' THEN 'contacted' ELSE 'dead' END AS state,
  retry_count, decided_at, CASE WHEN decided_at IS NULL THEN last_soft + INTERVAL 60 SECOND END AS retry_at
FROM r LEFT JOIN t ON r.email = t.email"""


@query("delivery_outcome", DELIVERY_SQL)
def delivery_outcome(spark, sf):
    return O.delivery_outcome(deliveries(read_table(spark, sf, "events")))


@query("fallback_leads", f"""WITH {S.LEAD_STORE},
dead AS (SELECT email AS dead_email, row_number() OVER (ORDER BY {S.key_hash('email')}, email) AS n FROM lead_store WHERE delivery_failed),
pool AS (SELECT email, company_name, founder_name, row_number() OVER (ORDER BY {S.key_hash('email')}, email) AS n FROM lead_store
         WHERE NOT contacted)
SELECT dead_email, email, company_name, founder_name FROM dead LEFT JOIN pool ON dead.n = pool.n""")
def fallback_leads(spark, sf):
    store = lead_store(spark, sf)
    return O.fallback_leads(store.where("delivery_failed"), store).select(
        "dead_email", "email", "company_name", "founder_name")


def chat_messages(turns):
    """Conversation turns as bot messages; only users write in the known chat."""
    text = (F.when(F.col("turn") == 1, F.lit(None)).when(F.col("turn") == 2, " 2 ").when(F.col("turn") == 4, "1\n")
            .when(F.col("conv_id") % 3 == 0, F.concat(F.lit("me"), F.col("conv_id").cast("string"), F.lit("@x.test")))
            .otherwise(F.col("text")))
    return turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("update_id"),
                        F.when(F.col("role") == "user", "42").otherwise("7").alias("chat_id"), text.alias("text"))


MESSAGES = """
messages AS (SELECT conv_id * 100 + turn AS update_id, CASE WHEN role = 'user' THEN '42' ELSE '7' END AS chat_id,
    CASE WHEN turn = 1 THEN NULL WHEN turn = 2 THEN ' 2 ' WHEN turn = 4 THEN '1' || chr(10)
         WHEN conv_id % 3 = 0 THEN 'me' || conv_id || '@x.test' ELSE text END AS text FROM conversations),
routed AS (SELECT *, CASE WHEN text IS NULL THEN 'ignored' WHEN chat_id <> '42' THEN 'unauthorised' WHEN contains(text, '@') THEN 'custom_test'
    ELSE CASE trim(text, ' ' || chr(10) || chr(9) || chr(13)) WHEN '1' THEN 'graph' WHEN '2' THEN 'stats' WHEN '3' THEN 'menu'
         WHEN '4' THEN 'deliverability' ELSE 'menu' END END AS command FROM messages)"""


@query("message_route", f"WITH {MESSAGES} SELECT update_id, chat_id, command FROM routed")
def message_route(spark, sf):
    messages = chat_messages(read_table(spark, sf, "conversations"))
    return route_messages(messages, "42").select("update_id", "chat_id", "command")


@query("message_offsets", f"""WITH {MESSAGES}
SELECT chat_id, max(update_id) + 1 AS next_offset, count(*) AS n_new FROM messages WHERE update_id >= 1000 GROUP BY chat_id""")
def message_offsets(spark, sf):
    new = messages_from(chat_messages(read_table(spark, sf, "conversations")), 1000)
    counts = new.groupBy("chat_id").agg(F.count("*").alias("n_new"))
    return next_offsets(new, ["chat_id"]).join(counts, "chat_id")
