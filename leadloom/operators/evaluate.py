"""Page evaluation: rules by default, or a caller's model over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from leadloom.config import ERROR_PREFIX, HIGH_VALUE_WORDS, LOW_VALUE_WORDS, OFF_TOPIC_WORDS, TOPIC_WORDS, UNKNOWN_NAME
from leadloom.functions.decisions import parse_decision
from leadloom.functions.patterns import any_of
from leadloom.functions.urls import rank_url


def evaluate_by_rules(pages: DataFrame, topic_words: Sequence[str] = TOPIC_WORDS,
                      off_topic_words: Sequence[str] = OFF_TOPIC_WORDS, high: Sequence[str] = HIGH_VALUE_WORDS,
                      low: Sequence[str] = LOW_VALUE_WORDS) -> DataFrame:
    """Add ``decision`` to pages with text, emails and links (array of normalised URLs).

    CONVERT needs a topic word and a clean e-mail; FOLLOW needs a topic word
    and a visible contact-like link; off-topic pages are always pruned.
    """
    lowered, targets = F.lower("text"), F.filter("links", lambda u: rank_url(u, high, low) == 0)
    # Facts first, as columns: each is computed once and then used several times.
    facts = pages.withColumns({
        "__on": F.coalesce(lowered.rlike(any_of(topic_words)), F.lit(False)),
        "__off": F.coalesce(lowered.rlike(any_of(off_topic_words)), F.lit(False)) if off_topic_words else F.lit(False),
        "__targets": F.coalesce(F.array_sort(F.array_distinct(targets)), F.array().cast("array<string>")),
    })
    on_topic, off_topic = F.col("__on"), F.col("__off")
    has_email, has_target = F.size("emails") > 0, F.size("__targets") > 0
    facts = facts.withColumn("__decision", (
        F.when(off_topic | ~on_topic, "PRUNE").when(has_email, "CONVERT")
        .when(has_target, "FOLLOW").otherwise("PRUNE")))
    summary = (
        F.when(off_topic, "off-topic page").when(~on_topic, "no topic match")
        .when(has_email, "topic match with e-mail").when(has_target, "topic match, contact link visible")
        .otherwise("topic match without contact")
    )
    decision = F.struct(
        F.col("__decision").alias("decision"), summary.alias("discovery_summary"),
        F.when(F.col("__decision") == "FOLLOW", F.col("__targets")).otherwise(F.array().cast("array<string>"))
        .alias("next_target_urls"),
        F.lit(UNKNOWN_NAME).alias("company"), F.lit(UNKNOWN_NAME).alias("person"),
        F.when(F.col("__decision") == "CONVERT", F.element_at("emails", 1)).alias("email"), F.lit("").alias("reason"),
    )
    return facts.withColumn("decision", decision).drop("__on", "__off", "__targets", "__decision")


def answer_with_model(prompts: DataFrame, make_model: Callable[[], Callable[[list[str]], list[str]]],
                      keys: Sequence[str] = ("url",), prompt: str = "prompt", answer: str = "answer") -> DataFrame:
    """Run a caller's text model over prompt rows, one Arrow batch at a time.

    ``make_model`` runs once per partition and returns a function from a list
    of prompts to a list of answers. If a batch fails, its prompts are tried
    one by one, so an error marks its own row only and the job goes on.
    """
    schema = T.StructType([prompts.schema[k] for k in keys] + [
        T.StructField(answer, T.StringType()), T.StructField("error", T.StringType())])

    def ask(model, texts: list[str]) -> tuple[list, list]:
        try:
            found = list(model(texts))
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} answers to {len(texts)} prompts")
            return found, [None] * len(texts)
        except Exception as exc:  # noqa: BLE001 - reported per row
            if len(texts) == 1:
                return [None], [str(exc)]
        parts = [ask(model, [t]) for t in texts]
        return [a for p, _ in parts for a in p], [e for _, q in parts for e in q]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            out = batch[list(keys)].copy()
            out[answer], out["error"] = ask(model, batch[prompt].tolist()) if len(batch) else ([], [])
            yield out

    return prompts.select(*keys, prompt).mapInPandas(run, schema)


def evaluate_with_model(pages: DataFrame, make_model: Callable[[], Callable[[list[str]], list[str]]],
                        prompt: Column) -> DataFrame:
    """``pages`` with ``decision``, parsed from model answers (JSON); usable as the ``evaluate`` step of a crawl.

    A failed row is PRUNE, with the error's message in its summary.
    """
    columns = pages.columns
    answers = answer_with_model(pages.withColumn("__prompt", prompt), make_model, columns, "__prompt", "__answer")
    parsed = answers.withColumn("decision", parse_decision(F.col("__answer")))
    summary = F.when(F.col("error").isNotNull(), F.concat(F.lit(ERROR_PREFIX), "error")).otherwise(
        F.col("decision.discovery_summary"))
    return parsed.select(*[F.col(f"`{c}`") for c in columns],
                         F.col("decision").withField("discovery_summary", summary).alias("decision"))
