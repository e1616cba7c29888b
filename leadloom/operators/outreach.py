"""Outreach: messages, send schedule, delivery outcome, replacements."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from leadloom.config import (
    DRAFT_COMPANY, DRAFT_FOUNDER, NOTIFICATION_LABELS, NOTIFICATION_TITLE, PLACEHOLDER_MARKER,
)
from leadloom.functions.hashing import HASH_SPACE, key_hash
from leadloom.operators.leads import oldest_uncontacted
from leadloom.operators.slices import number_rows, running_total
from leadloom.session import parallelism, write_scratch

_FIELDS = ("founder_name", "company_name")


def or_default(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def render_outreach(leads: DataFrame, template: str) -> DataFrame:
    """Add ``body``. A placeholder other than the two known ones is refused up front."""
    unknown = set(re.findall(r"\{([^{}]*)\}", template)) - set(_FIELDS)
    if unknown:
        raise ValueError(f"unknown placeholders in template: {sorted(unknown)}")
    values = {"founder_name": or_default(F.col("founder_name"), DRAFT_FOUNDER),
              "company_name": or_default(F.col("company_name"), DRAFT_COMPANY)}
    # Text and fields alternate, so a name that looks like a placeholder stays as it is.
    pieces = re.split(r"(\{(?:founder_name|company_name)\})", template)
    parts = [values[p[1:-1]] if p[1:-1] in values and p.startswith("{") else F.lit(p) for p in pieces if p]
    return leads.withColumn("body", F.concat(*parts) if parts else F.lit(""))


def notification(email: Column, company: Column, founder: Column) -> Column:
    """Title, empty line, one labelled line each."""
    lines = [F.concat(F.lit(f"<b>{label}:</b> "), value)
             for label, value in zip(NOTIFICATION_LABELS, (email, company, founder))]
    return F.concat(F.concat_ws("\n", F.lit(NOTIFICATION_TITLE), F.lit(""), *lines), F.lit("\n"))


def outreach_backlog(store: DataFrame, new_leads: DataFrame, n: int = 1) -> DataFrame:
    """The oldest uncontacted lead goes before the new ones (queue_group 0, then 1)."""
    backlog = oldest_uncontacted(store, n).select(
        F.lit("").alias("url"), "company_name", "founder_name", "email", F.lit("backlog").alias("source"),
        F.lit(0).cast("bigint").alias("queue_group"))
    fresh = new_leads.select("url", "company_name", "founder_name", "email", F.lit("new").alias("source"),
                             F.lit(1).cast("bigint").alias("queue_group"))
    return backlog.unionByName(fresh)


def jittered_gap(key: Column, base: int, seed: int) -> Column:
    """Whole seconds in [0.8 base, 1.2 base], both ends included."""
    low, high = int(base * 0.8), int(base * 1.2)
    return F.lit(low).cast("bigint") + key_hash(key, seed) % F.lit(high - low + 1).cast("bigint")


def send_schedule(leads: DataFrame, sender: str = "sender", interval_sec: int = 900, seed: int = 42,
                  exclude_placeholders: bool = True) -> DataFrame:
    """Seconds after start at which each lead is sent, per sender, oldest lead first.

    Leads found in the same second go in hash order, which gives a number that
    can be cut into even slices however many leads share a sender or a day.
    """
    queued = leads.where(~F.col("email").contains(PLACEHOLDER_MARKER)) if exclude_placeholders else leads
    tie = key_hash(F.col("email"), seed)
    queued = queued.withColumns({
        "gap_sec": jittered_gap(F.col("email"), interval_sec, seed),
        "__position": F.unix_seconds(F.col("date_found").cast("timestamp")) * (1 << 20) + F.shiftright(tie, 12),
    })
    # Read three times below; written once, so that joins before it run once.
    queued = write_scratch(queued, "queued")
    return running_total(queued, "gap_sec", ["__position", "email"], "__position", "send_offset_sec",
                         keys=[sender]).drop("__position")


def delivery_outcome(deliveries: DataFrame, max_retries: int = 1, retry_delay_sec: int = 60,
                     key: str = "email", order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Final state per lead from delivery attempts (key, ts, event_id, outcome).

    ok: contacted. soft_fail: retry while the budget lasts, then dead.
    hard_bounce: dead at once. The first terminal attempt decides.

    Only the first ``max_retries + 1`` attempts of each kind can matter, and
    that limit is applied before the shuffle, so a key with any number of
    attempts sends a handful of rows per task.
    """
    kinds = Window.partitionBy(key, "outcome").orderBy(*order)
    early = deliveries.where(F.col("outcome").isin("ok", "soft_fail", "hard_bounce")).select(
        key, "outcome", *order).withColumn("nth", F.row_number().over(kinds)).where(
        F.col("nth") <= max_retries + 1)
    at = F.struct(*order)
    is_last = F.col("nth") == F.when(F.col("outcome") == "soft_fail", max_retries + 1).otherwise(1)
    state = F.when(F.col("outcome") == "ok", "contacted").otherwise("dead")
    terminal = F.when(is_last, F.struct(at.alias("at"), state.alias("state")))
    # After the budget is used up a further soft failure is terminal, so the
    # soft failures at or before the terminal attempt are the retries.
    per_key = early.groupBy(key).agg(
        F.min(terminal).alias("terminal"),
        F.sort_array(F.collect_list(F.when(F.col("outcome") == "soft_fail", at))).alias("soft"))
    first_time = order[0]
    retries = F.filter("soft", lambda s: F.col("terminal").isNull() | (s < F.col("terminal.at")))
    per_key = per_key.withColumn("retries", retries)
    waiting = F.col("terminal").isNull()
    return per_key.select(
        key,
        F.when(waiting, "retry").otherwise(F.col("terminal.state")).alias("state"),
        F.least(F.size("retries"), F.lit(max_retries)).cast("bigint").alias("retry_count"),
        F.col(f"terminal.at.{first_time}").alias("decided_at"),
        F.when(waiting, F.element_at("retries", -1)[first_time] + F.expr(f"INTERVAL {retry_delay_sec} SECONDS"))
        .alias("retry_at"),
    )


def fallback_leads(dead: DataFrame, store: DataFrame, seed: int = 42) -> DataFrame:
    """One uncontacted lead for each dead lead, both in hash order.

    The hash spreads evenly, so the slices are known without a look at the data.
    """
    pieces = parallelism(dead.sparkSession)
    bounds = [HASH_SPACE * i // pieces for i in range(1, pieces)]

    def numbered(df: DataFrame) -> DataFrame:
        return number_rows(df.withColumn("__h", key_hash(F.col("email"), seed)), ["__h", "email"], "__h", "n",
                           bounds=bounds).drop("__h")

    lost = numbered(dead.select("email").distinct()).select(F.col("email").alias("dead_email"), "n")
    pool = store.where(~F.col("contacted")).join(dead.select("email").distinct(), "email", "left_anti")
    pool = numbered(pool.select("email", "company_name", "founder_name"))
    return lost.join(pool, "n", "left").drop("n")
