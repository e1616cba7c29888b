"""Leads: clean-up, deliverability, store, status changes, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.config import MISSING_NAME, PLACEHOLDER_MARKER, STORE_FOUNDER, STORE_REASON
from leadloom.functions.hashing import key_hash

_FILLER_KEYS = 4096


def _lookup_key(rows: DataFrame, email: Column, needed: Column) -> Column:
    """Join key of rows whose e-mail is worth looking up.

    The others (no address, placeholders) may be most of the table and share
    few values. They get one of many keys that match nothing, so they spread
    over all tasks instead of meeting in one.
    """
    filler = F.concat(F.lit("no lookup "), F.pmod(F.xxhash64(*rows.columns), F.lit(_FILLER_KEYS)).cast("string"))
    return F.when(needed, email).otherwise(filler)


def clean_lead(df: DataFrame) -> DataFrame:
    """Trim e-mail, company and person; missing company and person become N/A."""
    text = lambda c, default: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(default)))
    return df.withColumns({"email": text("email", ""), "company": text("company", MISSING_NAME),
                           "person": text("person", MISSING_NAME)})


def is_deliverable(email: Column, verdict: Column, verification: bool = True) -> Column:
    """Only a missing ``@`` or the verdict ``invalid`` fails; everything else passes."""
    has_at = F.coalesce(email.contains("@"), F.lit(False))
    if not verification:
        return has_at
    return has_at & (F.coalesce(verdict, F.lit("unknown")) != "invalid")


def with_deliverability(leads: DataFrame, verdicts: DataFrame, verification: bool = True) -> DataFrame:
    """Left join of verdicts (email, result); no verdict counts as unknown."""
    judged = verdicts.groupBy(F.col("email").alias("__key")).agg(F.max("result").alias("verdict"))
    has_at = F.coalesce(F.col("email").contains("@"), F.lit(False))
    keyed = leads.withColumn("__key", _lookup_key(leads, F.col("email"), has_at))
    return keyed.join(judged, "__key", "left").drop("__key").withColumn(
        "deliverable", is_deliverable(F.col("email"), F.col("verdict"), verification))


def placeholder_email(company: Column) -> Column:
    return F.concat(F.lit(PLACEHOLDER_MARKER + "@"), F.lower(F.replace(company, F.lit(" "), F.lit(""))),
                    F.lit(".com"))


def flag_for_enrichment(leads: DataFrame) -> DataFrame:
    """Undeliverable addresses become a placeholder built from the company name."""
    return leads.withColumn("email", F.when(F.col("deliverable"), F.col("email")).otherwise(
        placeholder_email(F.col("company"))))


def not_yet_stored(leads: DataFrame, store: DataFrame, only_contacted: bool = False) -> DataFrame:
    """Drop leads whose e-mail is stored; placeholders always pass.

    """
    known = store.where("contacted") if only_contacted else store
    known = known.select(F.col("email").alias("__key")).distinct()
    placeholder = F.coalesce(F.col("email").contains(PLACEHOLDER_MARKER), F.lit(False))
    keyed = leads.withColumn("__key", _lookup_key(leads, F.col("email"), ~placeholder))
    return keyed.join(known, "__key", "left_anti").drop("__key")


def build_leads(converted: DataFrame) -> DataFrame:
    """The fixed lead record of freshly converted pages."""
    return converted.select(
        F.col("url"), F.col("company").alias("company_name"), F.col("person").alias("founder_name"), F.col("email"),
        F.lit(True).alias("is_qualified"), F.lit(None).cast("string").alias("drafted_email"),
        F.lit(0).alias("retry_count"))


def first_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row of each key. Combines on the map side, so a hot key costs one row per task."""
    rest = [c for c in rows.columns if c != key and c not in order]
    packed = rows.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("__row"))
    return packed.select(*[F.col(c) if c == key else F.col(f"__row.{c}").alias(c) for c in rows.columns])


def new_store_rows(leads: DataFrame, store: DataFrame, order: list[str]) -> DataFrame:
    """Insert-ignore: first lead per e-mail, if the store does not have it yet.

    Input columns: email, company_name, founder_name, reason, date_found, and
    those in ``order``. Output has the store schema.
    """
    rows = leads.select(
        "email", "company_name", F.coalesce("founder_name", F.lit(STORE_FOUNDER)).alias("founder_name"),
        F.coalesce("reason", F.lit(STORE_REASON)).alias("reason"), "date_found",
        *[c for c in order if c not in ("date_found",)])
    fresh = first_per_key(rows, "email", order).join(store.select("email"), "email", "left_anti")
    return fresh.select("email", "company_name", "founder_name", "reason", F.lit(False).alias("contacted"),
                        F.lit(False).alias("delivery_failed"), "date_found")


def unvisited(urls: DataFrame, visited: DataFrame, url_hash: str = "url_hash") -> DataFrame:
    return urls.join(visited.select(url_hash), url_hash, "left_anti")


def new_visited_rows(urls: DataFrame, visited: DataFrame, at: Column) -> DataFrame:
    """First sight of each URL, ready to append to the visited table."""
    fresh = urls.select(F.sha2("url", 256).alias("url_hash"), "url").dropDuplicates(["url_hash"])
    return unvisited(fresh, visited).withColumn("visited_at", at)


def _one_per_lead(updates: DataFrame) -> DataFrame:
    return updates.groupBy("email").agg(F.bool_or(F.col("status") == "failed").alias("__failed"))


def apply_status(store: DataFrame, updates: DataFrame) -> DataFrame:
    """New version of the store after updates (email, status contacted or failed).

    A failed lead counts as contacted too, which takes it off the queue.
    """
    changed = store.join(_one_per_lead(updates), "email", "left")
    return changed.withColumns({
        "contacted": F.col("contacted") | F.col("__failed").isNotNull(),
        "delivery_failed": F.col("delivery_failed") | F.coalesce("__failed", F.lit(False)),
    }).drop("__failed")


def rejected_updates(store: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates for e-mails the store does not know."""
    return updates.join(store.select("email"), "email", "left_anti")


def hunt_stats(store: DataFrame, visited: DataFrame) -> DataFrame:
    """total_leads, uncontacted_leads, visited_urls in one row."""
    zero = F.lit(0).cast("bigint")
    leads = store.agg(F.count("email").alias("total_leads"),
                      F.count_if(~F.col("contacted")).alias("uncontacted_leads"), F.max(zero).alias("visited_urls"))
    urls = visited.agg(F.max(zero).alias("total_leads"), F.max(zero).alias("uncontacted_leads"),
                       F.count("url_hash").alias("visited_urls"))
    both = leads.unionByName(urls)
    return both.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in both.columns])


def oldest_uncontacted(store: DataFrame, n: int = 1) -> DataFrame:
    return store.where(~F.col("contacted")).orderBy("date_found", "email").limit(n)


def random_uncontacted(store: DataFrame, n: int = 1, seed: int = 42) -> DataFrame:
    """Uncontacted leads in seeded hash order: repeatable on any partitioning."""
    return (store.where(~F.col("contacted")).withColumn("__h", key_hash(F.col("email"), seed))
            .orderBy("__h", "email").limit(n).drop("__h"))
