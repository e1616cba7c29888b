"""Connected groups of a link table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadloom.session import discard, write_scratch


def _jumped(hooks: DataFrame) -> DataFrame:
    """Every node's root from a table (node, up) of pointers to smaller nodes; the way halves in every round."""
    while True:
        far = hooks.select(F.col("node").alias("up"), F.col("up").alias("next"))
        jumped = write_scratch(hooks.join(far, "up", "left").select(
            "node", F.coalesce("next", "up").alias("up"), (F.col("next") < F.col("up")).alias("moved")), "jumps")
        more = not jumped.where("moved").isEmpty()
        discard(hooks)
        hooks = jumped
        if not more:
            return hooks


def connected_groups(links: DataFrame) -> DataFrame:
    """(node, group) of every node of the links (a, b: bigint); group is one of its nodes.

    In a round every node points to its smallest neighbour if that is smaller,
    pointers are followed to their ends by jumping, and links are carried over
    to the ends. Give nodes hashed numbers: in random order a third of them or
    fewer is left after each round, also of a long chain.
    """
    rest = write_scratch(links.where("a <> b").select("a", "b").distinct(), "links")
    placed = write_scratch(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("group", F.col("node")), "groups")
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("up"))
        ends = _jumped(write_scratch(hooks, "hooks"))
        moved = write_scratch(placed.join(ends.select(F.col("node").alias("group"), "up"), "group", "left").select(
            "node", F.coalesce("up", "group").alias("group")), "groups")
        left, right = (ends.select(F.col("node").alias(x), F.col("up").alias(f"{x}_end")) for x in "ab")
        carried = write_scratch(rest.join(left, "a").join(right, "b").select(F.col("a_end").alias("a"), F.col("b_end").alias("b"))
                                .where("a <> b").distinct(), "links")
        discard(rest, placed, ends)
        rest, placed = carried, moved
    return placed
