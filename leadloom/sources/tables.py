"""Reading stored tables and appending to the lead, visited and graph stores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadloom.functions.urls import url_hash
from leadloom.operators.leads import new_store_rows, new_visited_rows
from leadloom.session import write_scratch
from leadloom.sources.buckets import BucketStore, write_buckets


def read_table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_for_parsing(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None,
                     spread: int | None = None) -> DataFrame:
    """A stored table whose rows are costly to process.

    A file of one row group is one task, whatever ``spark.sql.files.maxPartitionBytes``
    says. ``spread`` deals the rows out to that many tasks, which costs a shuffle
    of whole rows; without it the table is read as it is.
    """
    df = read_table(spark, folder, name, columns)
    return df.repartition(spread) if spread else df


def fetch_pages(requests: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """Stored HTML of the requested URLs (exact match)."""
    return pages.join(requests.select(url).distinct(), url, "left_semi")


def append_visited(urls: DataFrame, visited: DataFrame | BucketStore, path: str, at: Column) -> DataFrame:
    """Append URLs that the visited store does not hold; returns the added rows.

    The rows are fixed in a scratch table first, because the store they are
    compared with is about to grow. Of a bucket store only the buckets that the
    URLs fall into are read.
    """
    if isinstance(visited, BucketStore):
        urls = write_scratch(urls, "urls")
        wanted = urls.select(url_hash(F.col("url")).alias(visited.key))
        rows = write_scratch(new_visited_rows(urls, visited.holding(wanted).drop("bucket"), at), "visited")
        write_buckets(rows, path, visited.key, visited.buckets, append=True)
        return rows
    rows = write_scratch(new_visited_rows(urls, visited, at), "visited")
    rows.write.mode("append").parquet(path)
    return rows


def append_leads(leads: DataFrame, store: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Append leads with a new e-mail; the first one of a batch wins."""
    rows = write_scratch(new_store_rows(leads, store, order), "leads")
    rows.write.mode("append").parquet(path)
    return rows


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, format: str = "parquet") -> None:
    """Write ``<path>/nodes`` and ``<path>/edges`` as Parquet or JSON lines."""
    if format not in ("parquet", "json"):
        raise ValueError("format is parquet or json")
    nodes.write.format(format).save(f"{path}/nodes")
    edges.write.format(format).save(f"{path}/edges")


def import_graph(spark: SparkSession, path: str, node_schema, edge_schema, format: str = "parquet"):
    return (spark.read.schema(node_schema).format(format).load(f"{path}/nodes"),
            spark.read.schema(edge_schema).format(format).load(f"{path}/edges"))


def messages_from(messages: DataFrame, offset: int | None) -> DataFrame:
    """Messages at or after ``offset``; None reads all."""
    return messages if offset is None else messages.where(F.col("update_id") >= offset)


def next_offsets(messages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Where the next read starts: last update id + 1."""
    return messages.groupBy(*by).agg((F.max("update_id") + 1).alias("next_offset"))
