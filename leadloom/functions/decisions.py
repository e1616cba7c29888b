"""Parsing and routing of page decisions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadloom.config import ERROR_PREFIX, NO_SUMMARY, UNKNOWN_NAME

DECISIONS = ("CONVERT", "FOLLOW", "PRUNE")
_NO_STRINGS = "array<string>"


def parse_decision(json: Column) -> Column:
    """Struct of the fixed decision schema from one JSON text.

    Broken JSON, an unknown decision or a missing summary gives PRUNE with an
    error summary and no lead data. A single target counts as a list of one.
    """
    fields = F.from_json(
        json, "decision string, discovery_summary string, next_target_urls string, company string, "
              "person string, email string, reason string")
    valid = F.coalesce(fields["decision"].isin(*DECISIONS) & fields["discovery_summary"].isNotNull(), F.lit(False))
    raw = fields["next_target_urls"]
    # A scalar may start with a bracket too, as the link form [text](url) does.
    listed = F.coalesce(F.when(raw.startswith("["), F.from_json(raw, _NO_STRINGS)), F.when(raw != "", F.array(raw)))
    targets = F.filter(F.coalesce(listed, F.array().cast(_NO_STRINGS)), lambda t: t.isNotNull() & (t != ""))
    error = (
        F.when(fields["decision"].isNull() & fields["discovery_summary"].isNull(), "unreadable decision")
        .when(fields["discovery_summary"].isNull(), "summary is missing")
        .otherwise("decision is not one of " + ", ".join(DECISIONS))
    )

    def when_valid(value: Column) -> Column:
        return F.when(valid, value)

    return F.struct(
        when_valid(fields["decision"]).otherwise("PRUNE").alias("decision"),
        when_valid(fields["discovery_summary"]).otherwise(F.concat(F.lit(ERROR_PREFIX), error))
        .alias("discovery_summary"),
        when_valid(targets).otherwise(F.array().cast(_NO_STRINGS)).alias("next_target_urls"),
        when_valid(F.coalesce(fields["company"], F.lit(UNKNOWN_NAME))).alias("company"),
        when_valid(F.coalesce(fields["person"], F.lit(UNKNOWN_NAME))).alias("person"),
        when_valid(fields["email"]).alias("email"),
        when_valid(F.coalesce(fields["reason"], F.lit(""))).alias("reason"),
    )


def route(decision: Column) -> Column:
    return F.when(decision.isin("FOLLOW", "CONVERT"), decision).otherwise("PRUNE")


def summary_or_default(summary: Column) -> Column:
    return F.coalesce(summary, F.lit(NO_SUMMARY))
