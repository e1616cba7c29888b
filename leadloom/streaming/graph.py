"""Live discovery graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from leadloom.operators.graph import node_rows, state_changes
from leadloom.session import scratch_path
from leadloom.sources.versioned import VersionedStore
from leadloom.streaming.runs import run_each

#: What is kept of a node: its last state and title, and how many updates changed either.
NODE_STATE = T.StructType([
    T.StructField("node_id", T.StringType()), T.StructField("state", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("n_updates", T.LongType())])


def _per_node(batch: DataFrame) -> DataFrame:
    """(node_id, first, last, n): the updates of a batch that change something, in order of seq, as one row per node."""
    update = F.struct("state", "title")
    return state_changes(batch).groupBy("node_id").agg(
        F.min_by(update, "seq").alias("first"), F.max_by(update, "seq").alias("last"), F.count("*").alias("n"))


def _merged(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Node states after a batch. Its first change of a node counts only if it differs from the stored state."""
    old = stored.select("node_id", F.struct("state", "title").alias("old"), F.col("n_updates").alias("old_n"))
    both = old.join(batch, "node_id", "full")
    repeated = F.col("old_n").isNotNull() & F.col("first").eqNullSafe(F.col("old"))
    now = F.when(F.col("n").isNull(), F.col("old")).otherwise(F.col("last"))
    count = F.coalesce("old_n", F.lit(0)) + F.coalesce("n", F.lit(0)) - F.when(F.col("n").isNotNull() & repeated, 1).otherwise(0)
    return both.select("node_id", now["state"].alias("state"), now["title"].alias("title"), count.cast("bigint").alias("n_updates"))


def live_nodes(stream: DataFrame, path: str | None = None, buckets: int = 32) -> DataFrame:
    """Current state of each node; an update that repeats the node's state and title is dropped and not counted.

    Batches hold events in order of ``seq``, as they were sent. Inside a batch
    repeats are found in slices, so a node with a third of all events is work
    for many tasks; one row per node then meets the kept state. The state is a
    versioned store: a batch reads and rewrites the buckets of its own nodes, a
    repeated batch changes nothing.
    """
    spark = stream.sparkSession
    store = VersionedStore(spark, path or scratch_path(spark, "nodes"), NODE_STATE, "node_id", buckets)

    def apply(batch: DataFrame, batch_id: int) -> None:
        own = VersionedStore(batch.sparkSession, store.path, store.schema, store.key, store.buckets)
        own.update(_per_node(batch), _merged, version=batch_id)

    run_each(stream, store.path + "-checkpoint", apply)
    return node_rows(store.snapshot())
