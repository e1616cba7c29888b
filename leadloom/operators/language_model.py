"""A language detector fitted on labelled texts: character trigrams with Laplace-smoothed log probabilities.

Fitting is one aggregation over the words of the labelled table. The profiles
hold at most ``most`` trigrams per language, so their size doesn't grow with
the corpus: detecting sends them to the texts and shuffles one row of sums per
text and task, never words or trigrams. Scores are whole numbers (thousandths
of a natural logarithm), which makes sums equal in any order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from leadloom.session import write_scratch


@dataclass(frozen=True)
class LanguageModel:
    """profiles: gram, scores (one per language, in order); unknown: the scores of any other trigram."""

    languages: tuple[str, ...]
    profiles: DataFrame
    unknown: tuple[int, ...]


def _words(text: str) -> Column:
    """The words of a text: runs of letters, lower-cased."""
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0))


def word_counts(texts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """keys, word, n: how often each word stands in the texts of a key."""
    return texts.select(*keys, F.explode(_words(text)).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n"))


def _grams(word: str) -> Column:
    """All trigrams of a word with a mark at both ends."""
    marked = F.concat(F.lit("_"), F.col(word), F.lit("_"))
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(marked, i, 3))


def fit_languages(labelled: DataFrame, text: str = "text", language: str = "lang", most: int = 3000) -> LanguageModel:
    """The model of a labelled table; rows without label or text don't count.

    A trigram's probability is (count + 1) / (all + V): all counts of the
    language, V different trigrams over all languages. ``most`` frequent ones
    per language stay, ties in order of their letters; others count as unknown.
    """
    counted = word_counts(labelled.where(F.col(language).isNotNull()), [language], text)
    # Written once, since totals and profiles both read it; a row per language and trigram.
    grams = write_scratch(counted.select(F.col(language).alias("language"), F.explode(_grams("word")).alias("gram"), "n").groupBy(
        "language", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r["language"]: (r["all"], r["different"]) for r in grams.groupBy("language").agg(
        F.sum("n").alias("all"), F.count("*").alias("different")).collect()}  # a row per language
    languages = tuple(sorted(totals))
    if not languages:
        return LanguageModel((), grams.select("gram", F.array().cast("array<bigint>").alias("scores")), ())
    v = grams.agg(F.count_distinct("gram")).first()[0]
    score = lambda n, all_: F.round(1000 * F.log((n + 1) / (F.lit(all_) + v))).cast("bigint")
    unknown = tuple(labelled.sparkSession.range(1).select(*[
        score(F.lit(0), totals[x][0]).alias(f"u{i}") for i, x in enumerate(languages)]).first())
    place = Window.partitionBy("language").orderBy(F.desc("n"), "gram")
    kept = grams.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most)
    own = [F.max(F.when(F.col("language") == x, score(F.col("n"), totals[x][0]))) for x in languages]
    profiles = kept.groupBy("gram").agg(F.array(*[F.coalesce(c, F.lit(u)) for c, u in zip(own, unknown)]).alias("scores"))
    return LanguageModel(languages, profiles, unknown)


def detect_languages(texts: DataFrame, model: LanguageModel, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, language, n_grams: the most probable language of every text; no language for a text without letters.

    Equal scores go to the first language by name. Rows with equal keys are one text.
    """
    if not model.languages:
        return texts.select(*keys).distinct().select(*keys, F.lit(None).cast("string").alias("language"), F.lit(0).cast("bigint").alias("n_grams"))
    # A text without words keeps a row without trigram.
    words = texts.select(*keys, F.explode_outer(_words(text)).alias("word"))
    grams = words.select(*keys, F.explode_outer(_grams("word")).alias("gram"))
    profiles = model.profiles.select("gram", *[F.col("scores")[i].alias(f"p{i}") for i in range(len(model.languages))])
    total = [F.sum(F.when(F.col("gram").isNotNull(), F.coalesce(f"p{i}", F.lit(u).cast("bigint")))).alias(f"s{i}")
             for i, u in enumerate(model.unknown)]
    scored = grams.join(F.broadcast(profiles), "gram", "left").groupBy(*keys).agg(F.count("gram").alias("n_grams"), *total)
    ranked = F.array(*[F.struct((-F.col(f"s{i}")).alias("s"), F.lit(x).alias("language")) for i, x in enumerate(model.languages)])
    return scored.select(*keys, F.when(F.col("n_grams") > 0, F.array_min(ranked)["language"]).alias("language"), "n_grams")
