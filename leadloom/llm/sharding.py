"""Shards by extendible hashing.

The key's 64 hash bits, then 64 bits of the row's number, give every row its
path. A bucket is a prefix of the path; only buckets over the byte limit are
split on one more bit, until all fit or hold a single row. Rows with one key
share the first 64 bits and are told apart by the others, so a hot key is
split like any other bucket.

Bytes are added up per cell (a prefix somewhat longer than the expected
shards') with map-side combine; all prefixes of the cells then get their sums
in one pass. Only cells that are still over the limit go through the next bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.session import write_scratch

BITS = 128


def key_bits(key: Column) -> Column:
    """60 bits of the key's MD5, then 4 more, as text of 64 binary digits; null is a key of its own."""
    digest = F.md5(F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null")))
    parts = [F.lpad(F.conv(F.substring(digest, at, 8), 16, 2), 32, "0") for at in (1, 9)]
    return F.concat(*parts)


def row_bits(row: Column) -> Column:
    return F.lpad(F.bin(F.xxhash64(row)), 64, "0")


def _leaves(cells: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(leaf, bytes, rows) of the shortest prefixes within the limit, and the cells (length ``high``) still over it."""
    grown = cells.select("bytes", "rows", F.explode(F.transform(
        F.sequence(F.lit(low), F.lit(high)), lambda n: F.substring(F.col("cell"), F.lit(1), n))).alias("prefix"))
    sums = grown.groupBy("prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    sums = write_scratch(sums, "prefixes")
    fits = (F.col("bytes") <= limit) | (F.col("rows") == 1)
    parents = sums.where(~fits).select("prefix")
    candidates = sums.where(fits).withColumn("parent", F.expr("left(prefix, length(prefix) - 1)"))
    roots = candidates.where(F.length("prefix") == low)
    split = candidates.where(F.length("prefix") > low).join(parents.withColumnRenamed("prefix", "parent"), "parent", "left_semi")
    leaves = roots.unionByName(split).select(F.col("prefix").alias("leaf"), "bytes", "rows")
    return leaves, sums.where(~fits & (F.length("prefix") == high)).select(F.col("prefix").alias("cell"))


def sized_rows(df: DataFrame, key_col: str, bytes_of: Column) -> DataFrame:
    """(key, path, bytes) per row, written once, so that row numbers stay what they are."""
    numbered = write_scratch(df.select(F.col(key_col).alias("key"), bytes_of.cast("bigint").alias("bytes"))
                             .withColumn("row", F.monotonically_increasing_id()), "sized")
    return numbered.select("key", F.coalesce("bytes", F.lit(0)).alias("bytes"),
                           F.concat(key_bits(F.col("key")), row_bits(F.col("row"))).alias("path"))


def shards(rows: DataFrame, limit: int, spare_bits: int = 5) -> tuple[DataFrame, DataFrame]:
    """The directory (leaf, bytes, rows) and (key, bytes, leaf) per row of ``sized_rows``.

    leaf: the shard's path prefix. Every shard holds at most ``limit`` bytes
    or a single row. An empty table has an empty directory; null keys share a
    path and null sizes count 0.
    """
    total = rows.agg(F.sum("bytes").alias("b")).first().b or 0
    high = min(56, max(1, math.ceil(math.log2(max(2, total / limit))) + spare_bits))
    low, part, leaves, placed = 0, rows, None, None
    while True:
        cells = part.groupBy(F.substring("path", 1, high).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
        found, over = _leaves(cells, low, high, limit)
        found = write_scratch(found, "directory")
        over = write_scratch(over, "over")
        # A row's leaf is the leaf of its cell; both tables are one row per cell or shard, joined by the leaf's prefix.
        cell_leaf = (cells.select("cell", F.explode(F.transform(
            F.sequence(F.lit(low), F.lit(high)), lambda n: F.substring(F.col("cell"), F.lit(1), n))).alias("leaf"))
            .join(found.select("leaf"), "leaf"))
        mapped = part.withColumn("cell", F.substring("path", 1, high)).join(cell_leaf, "cell").select("key", "bytes", "leaf")
        leaves = found if leaves is None else leaves.unionByName(found)
        placed = mapped if placed is None else placed.unionByName(mapped)
        if high == BITS or over.isEmpty():
            return leaves, placed
        part = part.join(over.withColumnRenamed("cell", "head"), F.substring("path", 1, high) == F.col("head"), "left_semi")
        low, high = high + 1, BITS if high > 64 else min(BITS, max(64, high) + 24)


def write_shards(df: DataFrame, key_col: str, bytes_of: Column, limit: int, path: str) -> DataFrame:
    """Write ``df`` to ``path``, a folder per shard; returns the directory.

    Rows go to their shard's task by a join on (row number within the written
    copy); the copy is made once so that both see the same rows.
    """
    copy = write_scratch(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"),
                                   F.col(f"`{key_col}`").alias("__key"), bytes_of.cast("bigint").alias("__bytes"))
                         .withColumn("__n", F.monotonically_increasing_id()), "rows")
    rows = copy.select(F.struct("__key", "__n").alias("key"), F.coalesce("__bytes", F.lit(0)).alias("bytes"), F.concat(
        key_bits(F.col("__key")), row_bits(F.col("__n"))).alias("path"))
    leaves, placed = shards(rows, limit)
    placed = placed.select(F.col("key.__n").alias("__n"), F.concat(F.lit("s"), F.col("leaf")).alias("shard"))
    copy.join(placed, "__n").select("__row.*", "shard").repartition("shard").write.partitionBy("shard").parquet(path)
    return leaves
