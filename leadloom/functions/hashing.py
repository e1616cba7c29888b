"""Repeatable pseudo-random numbers from keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_SPACE = 1 << 32


def key_hash(key: Column, seed: int) -> Column:
    """A number in [0, 2^32) that depends on key and seed only."""
    digest = F.md5(F.concat(key, F.lit(f"|{seed}")))
    return F.conv(F.left(digest, F.lit(8)), 16, 10).cast("bigint")
