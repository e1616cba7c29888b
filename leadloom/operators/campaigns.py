"""Campaign intents and search queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from leadloom.config import FALLBACK_QUERY, GENERIC_JOB_WORDS, NO_LOCATION_TEXT
from leadloom.functions.patterns import any_of


def campaign_intent(campaigns: DataFrame) -> DataFrame:
    """Fill ``{locations}`` in ``intent``; no locations means everywhere."""
    places = F.when(F.coalesce(F.size("locations"), F.lit(0)) <= 0, F.lit(NO_LOCATION_TEXT)).otherwise(
        F.array_join("locations", ", "))
    return campaigns.withColumn("location_text", places).withColumn(
        "intent", F.replace(F.trim("intent"), F.lit("{locations}"), F.col("location_text")))


def campaign_queries(campaigns: DataFrame, categories: Sequence[tuple[str, int, Sequence[str]]],
                     discovery: Sequence[str]) -> DataFrame:
    """Boolean queries per campaign in the caller's category mix, each with one location.

    ``categories``: (name, number of queries, phrases). The slots (category, phrase) are a short literal array, exploded in the row,
    so nothing is shuffled. Slot i takes location i modulo the list length.
    """
    slots, position = [], 0
    for name, quota, phrases in categories:
        for i in range(quota):
            slots.append((position, name, phrases[i % len(phrases)], discovery[position % len(discovery)]))
            position += 1
    slot_array = F.array(*[
        F.struct(F.lit(p).cast("bigint").alias("slot"), F.lit(c).alias("category"), F.lit(a).alias("phrase"),
                 F.lit(d).alias("discovery")) for p, c, a, d in slots])
    rows = campaigns.where(F.size("locations") > 0).select(
        "campaign_id", "locations", F.explode(slot_array).alias("s")).select("campaign_id", "locations", "s.*")
    location = F.element_at("locations", (F.col("slot") % F.size("locations") + 1).cast("int"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    return rows.withColumn("location", location).select(
        "campaign_id", "slot", "category", "location",
        F.concat_ws(" AND ", quoted(F.col("phrase")), quoted(F.col("location")), quoted(F.col("discovery")))
        .alias("query"))


def with_fallback_query(campaigns: DataFrame, queries: DataFrame, default: str = FALLBACK_QUERY) -> DataFrame:
    """One row per campaign: its queries as an array, or one default query."""
    listed = queries.groupBy("campaign_id").agg(
        F.sort_array(F.collect_list(F.struct("slot", "query")))["query"].alias("queries"))
    return campaigns.join(listed, "campaign_id", "left").withColumn(
        "queries", F.when(F.coalesce(F.size("queries"), F.lit(0)) <= 0, F.array(F.lit(default)))
        .otherwise(F.col("queries")))


def check_query_sets(campaigns: DataFrame, at_least: int = 5, at_most: int = 10,
                     banned: Sequence[str] = GENERIC_JOB_WORDS) -> DataFrame:
    """Rules per campaign: number of queries, a location in each, no generic job words."""
    places = F.coalesce(F.col("locations"), F.array().cast("array<string>"))
    located = F.filter("queries", lambda q: F.exists(
        places, lambda p: F.instr(F.lower(q), F.lower(p)) > 0))
    generic = F.filter("queries", lambda q: F.lower(q).rlike(any_of(banned)))
    counted = campaigns.select(
        "campaign_id", F.size("queries").cast("bigint").alias("n_queries"),
        F.size(located).cast("bigint").alias("n_located"), F.size(generic).cast("bigint").alias("n_generic"))
    return counted.withColumn("passed", F.col("n_queries").between(at_least, at_most)
                              & (F.col("n_located") == F.col("n_queries")) & (F.col("n_generic") == 0))
