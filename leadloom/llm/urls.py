"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

The model is fitted on a small labelled table (at most ``max_rows`` rows, a
documented bound); it is one array of weights, sent with the task. Scoring is
a narrow pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from leadloom.llm import url_table

BUCKETS, SIZES = 1 << 18, (3, 4, 5)


def labelled_hosts() -> list[tuple[str, int]]:
    """(url, label) rows; see ``url_table``."""
    return [(url, label) for url, _, _, label in url_table.labelled()]


@dataclass(frozen=True)
class UrlRule:
    """``place``: host, slash and start of the path."""

    place: str
    verdict: str

    @property
    def host(self) -> str:
        return self.place.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.place.split("/", 1)[1]


#: Fixed by the result contract.
RULES = (UrlRule("org/", "allow"), UrlRule("example.org/es/", "block"), UrlRule("example.org/en/1", "block"),
         UrlRule("com/fr/", "allow"), UrlRule("com/de/", "block"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[UrlRule] = RULES) -> Column:
    """struct<place, verdict> of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<place:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.place)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.place).alias("place"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def grams(host: str, path: str) -> np.ndarray:
    """Bucket numbers of the distinct character n-grams of host and path."""
    found = {f"{kind}{s[i:i + n]}" for kind, s in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in SIZES
             for i in range(len(s) - n + 1)}
    return np.unique(np.fromiter((zlib.crc32(g.encode("utf-8", "replace")) % BUCKETS for g in found), np.int64,
                                 len(found)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, host: str, path: str) -> float:
        found = grams(host, path)
        z = self.bias + (self.weights[found].sum() / np.sqrt(len(found)) if len(found) else 0.0)
        return float(1 / (1 + np.exp(-z)))


def fit(labelled: DataFrame, max_rows: int = 10_000, rounds: int = 300, rate: float = 2.0, decay: float = 1e-5,
        unwanted: float = 0.3, momentum: float = 0.9) -> Model:
    """Logistic regression by gradient descent on at most ``max_rows`` labelled rows (host, path, label).

    ``unwanted``: the share of the unwanted label in the loss; below a half, a
    URL without evidence is allowed. Rows without a label are left out; an
    empty table gives a model that blocks nothing.
    """
    rows = labelled.where("label is not null").orderBy("host", "path", "label").limit(max_rows).collect()
    weights, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return Model(weights, -1.0)
    found = [grams(r.host, r.path) for r in rows]
    sizes = np.array([max(1, len(f)) for f in found])
    at = np.repeat(np.arange(len(rows)), [len(f) for f in found])
    flat = np.concatenate(found)
    share = 1 / np.sqrt(sizes)
    y = np.array([float(r.label) for r in rows])
    weight = np.where(y == 1, unwanted / max(1, y.sum()), (1 - unwanted) / max(1, (1 - y).sum()))
    speed, bias_speed = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        z = bias + np.bincount(at, weights[flat], len(rows)) * share
        slope = (1 / (1 + np.exp(-z)) - y) * weight
        speed = momentum * speed - rate * 10 * (np.bincount(flat, (slope * share)[at], BUCKETS) + decay * weights)
        bias_speed = momentum * bias_speed - rate * slope.sum()
        weights += speed
        bias += bias_speed
    return Model(weights, bias)


def judged(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url",
           rules: Sequence[UrlRule] = RULES, threshold: float = 0.5) -> DataFrame:
    """(id, host, path, rule, score, verdict) per row; verdict: the rule's, else block from ``threshold`` on.

    A null url, or one without ``://``, has an empty host and path and is
    scored as such; repeated rows get a row each.
    """
    places = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"),
                          path_of(F.col(url_col)).alias("path"))

    @F.pandas_udf("double")
    def scored(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([model.score(h, p) for h, p in zip(host, path)], dtype="float64")

    found = places.withColumn("found", rule_of(F.col("host"), F.col("path"))).withColumn("score", scored("host", "path"))
    return found.select("id", "host", "path", F.col("found.place").alias("rule"), "score", F.coalesce(
        F.col("found.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"))
