"""Lead events to lead store, and live statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadloom.operators.leads import new_store_rows
from leadloom.schemas import LEAD_STORE
from leadloom.session import scratch_path
from leadloom.sources.versioned import VersionedStore
from leadloom.streaming.runs import run_each


def insert_ignore(order: list[str]):
    """Merge step of a lead store: the first lead of an e-mail stays, rows of the store before all others."""
    def merge(stored: DataFrame, batch: DataFrame) -> DataFrame:
        return stored.unionByName(new_store_rows(batch, stored, order))

    return merge


def lead_sink(stream: DataFrame, order: list[str], path: str | None = None, initial: DataFrame | None = None,
              buckets: int = 32) -> DataFrame:
    """Insert-ignore every micro-batch into the store; returns the store.

    The store is versioned and keyed by e-mail. A batch reads and rewrites the
    buckets of its own e-mails only, whatever the batches before it wrote; a
    repeated batch finds its version there and changes nothing.
    """
    spark = stream.sparkSession
    store = VersionedStore(spark, path or scratch_path(spark, "lead-store"), LEAD_STORE, "email", buckets)
    if initial is not None and store.latest() is None:
        store.update(initial, lambda stored, rows: rows, version=0)

    def insert(batch: DataFrame, batch_id: int) -> None:
        own = VersionedStore(batch.sparkSession, store.path, store.schema, store.key, store.buckets)
        own.update(batch.where(F.col("email").isNotNull()), insert_ignore(order), version=batch_id + 1)

    run_each(stream, store.path + "-checkpoint", insert)
    return store.snapshot()


def live_stats(stream: DataFrame, contacted: str = "contacted") -> DataFrame:
    """Running totals; use complete mode."""
    return stream.agg(F.count("*").alias("total_leads"), F.count_if(~F.col(contacted)).alias("uncontacted_leads"))
