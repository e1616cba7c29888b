"""Connected components of an edge table, by alternating star contractions.

Each round replaces edges by edges to smaller neighbours (first towards larger
nodes, then towards smaller ones); a node's smallest neighbour is an
aggregation with map-side combine, so the centre of a large star costs one row
per task. Rounds grow with the logarithm of the longest chain. The edge table
is written once per round to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadloom.session import write_scratch


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"),
                    F.sum(F.xxhash64("b", "a") % 1_000_003).alias("s")).first()
    return row.n, row.x, row.s


def _towards_smaller(edges: DataFrame) -> DataFrame:
    """Large star: larger neighbours of a node point to its smallest neighbour."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (both.where("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Small star: smaller neighbours of a node, and the node, point to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; component: the smallest node reached.

    ``edges`` has bigint columns a and b, any direction, repeats and loops allowed.
    An empty table gives an empty table.
    """
    current = write_scratch(edges.where("a <> b").select("a", "b").distinct(), "edges")
    mark = _mark(current)
    while mark[0]:
        current = write_scratch(_small_star(_towards_smaller(current)), "edges")
        after = _mark(current)
        if after == mark:
            break
        mark = after
    roots = current.select(F.col("b").alias("node")).distinct()
    return (current.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(roots.select("node", F.col("node").alias("component"))))
