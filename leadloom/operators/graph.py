"""Discovery graph as tables: node state, state changes, edges."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.config import STATE_COLOURS
from leadloom.functions.html import escape_html
from leadloom.functions.urls import display_label, node_label
from leadloom.operators.slices import previous_value


def state_colour(state: Column, colours: Mapping[str, str] = STATE_COLOURS) -> Column:
    """Five-entry lookup; an unknown state is shown as pruned."""
    table = F.create_map(*[F.lit(x) for pair in colours.items() for x in pair])
    return F.coalesce(F.try_element_at(table, state), F.lit(colours["prune"]))


def tooltip(title: Column, node_id: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) == "", node_id).otherwise(escape_html(title))


def state_changes(events: DataFrame, position: str = "seq", pieces: int | None = None) -> DataFrame:
    """Drop updates that repeat the node's previous (state, title)."""
    current = F.struct(F.col("state"), F.col("title"))
    before = previous_value(events, current, [position], position, "__before", ["node_id"], pieces)
    return before.where(~F.col("__before").eqNullSafe(current)).drop("__before")


def graph_nodes(events: DataFrame, sticky_convert: bool = False) -> DataFrame:
    """One row per node: last state and title, first label, colour, tooltip.

    One map-side combined aggregation; a node with very many updates sends one
    row per task. ``sticky_convert`` keeps a converted node converted.
    """
    when_seen = F.col("seq")
    last_key = F.struct((F.col("state") == "convert").alias("c"), when_seen) if sticky_convert else when_seen
    nodes = events.groupBy("node_id").agg(
        F.max_by(F.struct("state", "title"), last_key).alias("last"), F.count("*").alias("n_updates"))
    return node_rows(nodes.select("node_id", "last.state", "last.title", "n_updates"))


def node_rows(states: DataFrame) -> DataFrame:
    """Nodes as they are shown, from (node_id, state, title, n_updates)."""
    return states.select(
        "node_id", display_label(node_label(F.col("node_id"))).alias("label"), "state", state_colour(F.col("state")).alias("colour"),
        tooltip(F.col("title"), F.col("node_id")).alias("title"), "n_updates")


def graph_edges(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct parent-to-child edges without loops whose ends both exist."""
    pairs = events.where(F.col("parent_id").isNotNull() & (F.col("parent_id") != "")
                         & (F.col("parent_id") != F.col("node_id")))
    edges = pairs.select(F.col("parent_id").alias("source"), F.col("node_id").alias("target")).distinct()
    ids = nodes.select("node_id")
    return (edges.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi")
            .join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi").select("source", "target"))
