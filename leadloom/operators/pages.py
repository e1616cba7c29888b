"""Stored pages to text, links, e-mails and observations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window, functions as F

from leadloom.config import EMAIL_IGNORED_SUFFIXES, HIGH_VALUE_WORDS, HuntConfig, LOW_VALUE_WORDS
from leadloom.functions import html as H
from leadloom.functions.context import cut_observation
from leadloom.functions.language import best_language, passes_language_guard, stop_word_hits
from leadloom.functions.urls import rank_url, with_normalized_url


# Long expressions over fixed column names are built once and reused.

@lru_cache(maxsize=None)
def _clean_column() -> Column:
    return H.remove_noise(F.col("html"))


@lru_cache(maxsize=None)
def _anchors_column(url: str) -> Column:
    return H.parse_anchors(H.anchor_stream(F.col("clean")), F.col(url))


@lru_cache(maxsize=None)
def _body_column() -> Column:
    return H.strip_tags(H.link_markdown(F.col("clean"), F.col("anchors")))


@lru_cache(maxsize=None)
def _emails_column(ignored_suffixes: tuple[str, ...]) -> Column:
    return H.clean_emails(H.all_emails(F.col("html")), ignored_suffixes)


@lru_cache(maxsize=None)
def _language_columns() -> tuple[Column, Column]:
    return stop_word_hits(F.col("body")), best_language(F.col("hits"))


def with_links(pages: DataFrame, url: str = "url") -> DataFrame:
    """Replace ``html`` by ``clean`` (no noise) and ``anchors`` (the parsed anchor stream, absolute by ``<base href>``)."""
    others = [c for c in pages.columns if c != "html"]
    clean = pages.select(*others, _clean_column().alias("clean"))
    based = clean.withColumn("__base", H.base_url(F.col("clean"), F.col(url)))
    return based.withColumn("anchors", _anchors_column("__base")).drop("__base")


def page_links(pages: DataFrame, keys: Sequence[str] = ("page_id",), page_url: str = "url") -> DataFrame:
    """One row per ``<a href>``: keys, page_url, pos, href, link_text, url (normalised, relative to ``<base href>``)."""
    clean = pages.select(*keys, F.col(page_url).alias("page_url"), _clean_column().alias("clean"))
    based = clean.withColumn("base_url", H.base_url(F.col("clean"), F.col("page_url")))
    found = based.select(*keys, "page_url", "base_url", F.posexplode(H.find_anchors(F.col("clean"))).alias("pos", "a"))
    found = found.select(*keys, "page_url", "base_url", F.col("pos").cast("bigint").alias("pos"),
                         H.anchor_href(F.col("a")).alias("href"), H.anchor_text(F.col("a")).alias("link_text"))
    return with_normalized_url(found.where("href != ''"), "base_url", "href", "url").drop("base_url")


def page_text(pages: DataFrame) -> DataFrame:
    """Replace ``html`` by ``body``: visible text with links as ``[text](absolute-href)``."""
    linked = with_links(pages)
    return linked.withColumn("body", _body_column()).drop(
        "clean", "anchors")


def top_links(links: DataFrame, keys: Sequence[str] = ("page_id",), max_leafs: int = 4, url: str = "url",
              high: Sequence[str] = HIGH_VALUE_WORDS, low: Sequence[str] = LOW_VALUE_WORDS, unique: bool = False) -> DataFrame:
    """Best ``max_leafs`` distinct URLs per page by (rank, url).

    The duplicates go in a map-side combine, and Spark keeps at most
    ``max_leafs`` rows per page and map task before it shuffles for the window.
    ``unique``: no link comes twice, so there is nothing to combine.
    """
    order = Window.partitionBy(*keys).orderBy("link_rank", url)
    found = links.select(*keys, url)
    return (
        (found if unique else found.distinct())
        .withColumn("link_rank", rank_url(F.col(url), high, low))
        .withColumn("leaf", F.row_number().over(order))
        .where(F.col("leaf") <= max_leafs)
    )


def observations(pages: DataFrame, config: HuntConfig = HuntConfig(),
                 ignored_suffixes: Sequence[str] = EMAIL_IGNORED_SUFFIXES, language: str = "en",
                 detector: Callable[[Column], Column] | None = None) -> DataFrame:
    """Pages ready for evaluation: every input column but ``html``, and more.

    Adds ``emails`` (clean ones), ``links`` (normalised URLs in page order),
    ``language``, ``status`` (ok, blank or other_language) and ``text``, which
    has the e-mail header and is cut to the limit. Pages that are not ok have
    an empty text. ``detector`` may be any text-to-language Column function, a
    pandas UDF included.

    Values used more than once are columns of their own, so each is computed
    once per page.
    """
    others = [c for c in pages.columns if c != "html"]
    found = with_links(pages.withColumn(
        "emails", _emails_column(tuple(ignored_suffixes))))
    usable = F.filter("anchors", lambda a: a["href"] != "")
    seen = found.select(
        *others, "emails",
        F.transform(usable, lambda a: F.rtrim(F.substring_index(a["absolute"], "#", 1), F.lit("/"))).alias("links"),
        _body_column().alias("body"))
    if detector is None:
        hits, best = _language_columns()
        seen = seen.withColumn("hits", hits).withColumn("language", best)
    else:
        seen = seen.withColumn("language", detector(F.col("body")))
    status = (
        F.when(F.coalesce(F.trim("body"), F.lit("")) == "", "blank")
        .when(~passes_language_guard(F.col("language"), language), "other_language")
        .otherwise("ok")
    )
    text = cut_observation(H.with_email_header(F.col("body"), F.col("emails")), config.max_observation_chars)
    return seen.withColumn("status", status).select(
        *others, "emails", "links", "language", "status",
        F.when(F.col("status") == "ok", text).otherwise("").alias("text"))
