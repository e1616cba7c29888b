"""Language guess from stop words."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from leadloom.config import STOP_WORDS


def stop_word_hits(text: Column, stop_words: Mapping[str, Sequence[str]] = STOP_WORDS) -> Column:
    """The stop words of any language that occur in the text, repeats included."""
    every = sorted({w for words in stop_words.values() for w in words})
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda t: t.isin(*every))


def best_language(hits: Column, stop_words: Mapping[str, Sequence[str]] = STOP_WORDS) -> Column:
    """Language with most hits (the first listed wins a tie); NULL without hits."""
    def score(words: Sequence[str]) -> Column:
        return F.size(F.filter(hits, lambda t: t.isin(*words)))

    scores = F.array_max(F.array(*[
        F.struct(score(words).alias("score"), F.lit(-i).alias("order"), F.lit(lang).alias("lang"))
        for i, (lang, words) in enumerate(stop_words.items())
    ]))
    return F.when(F.size(hits) > 0, scores["lang"])


def detect_language(text: Column, stop_words: Mapping[str, Sequence[str]] = STOP_WORDS) -> Column:
    return F.transform(F.array(stop_word_hits(text, stop_words)), lambda h: best_language(h, stop_words))[0]


def passes_language_guard(language: Column, wanted: str = "en") -> Column:
    """Unknown language passes."""
    return F.coalesce(language == wanted, F.lit(True))
