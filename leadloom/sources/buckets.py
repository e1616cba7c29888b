"""Stores cut into buckets by a hash of their key, so that a lookup opens only the buckets that it needs.

Layout: ``<path>/of=<buckets>/bucket=<n>/…``, rows sorted by key inside a file.
A lookup finds the buckets of the wanted keys first (at most ``buckets`` numbers
reach the driver) and reads those as partitions: the scan shows partition
filters, files of other buckets are not opened. While the wanted keys are few,
as in the late rounds and release passes of a crawl, that is a small part of
the store; keys in all buckets cost a scan of all.

Take as many buckets as the store has parts of some hundred megabytes, and
``files`` above 1 if a bucket should be read and written by several tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MOST_BUCKETS = 10_000


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_buckets(rows: DataFrame, path: str, key: str, buckets: int = 64, files: int = 1, append: bool = False) -> None:
    """Write rows to their buckets. Appending needs the number of buckets that the store has."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"between 1 and {MOST_BUCKETS} buckets")
    spread = F.pmod(F.hash(F.col(key)), F.lit(files))
    (rows.withColumns({"of": F.lit(buckets), "bucket": bucket_of(F.col(key), buckets)})
     .repartition(F.col("bucket"), spread).sortWithinPartitions("bucket", key)
     .write.mode("append" if append else "errorifexists").partitionBy("of", "bucket").parquet(path))


@dataclass(frozen=True)
class BucketStore:
    """A written store; ``table`` has its rows with the columns ``of`` and ``bucket``."""

    table: DataFrame
    key: str
    buckets: int

    @classmethod
    def open(cls, spark: SparkSession, path: str, key: str) -> BucketStore:
        table = spark.read.parquet(path)
        first = table.select("of").first()
        if first is None:
            raise ValueError(f"{path} holds no rows")
        return cls(table, key, int(first["of"]))

    def rows(self) -> DataFrame:
        """All rows."""
        return self.table.drop("of", "bucket")

    def holding(self, wanted: DataFrame, column: str | None = None) -> DataFrame:
        """The rows of all buckets that the keys in ``wanted`` fall into, bucket included; null keys fall into none.

        ``wanted`` should be a written table, since it is read for its bucket numbers.
        """
        key = F.col(column or self.key)
        found = wanted.where(key.isNotNull()).select(bucket_of(key, self.buckets).alias("bucket")).distinct().collect()
        numbers = sorted(r["bucket"] for r in found)
        return self.table.where((F.col("of") == self.buckets) & F.col("bucket").isin(numbers)).drop("of")

    def matching(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` joined with the rows of its keys (``key`` is a column of both)."""
        keyed = wanted.withColumn("bucket", bucket_of(F.col(self.key), self.buckets))
        return keyed.join(self.holding(wanted), ["bucket", self.key]).drop("bucket")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The rows of ``wanted`` whose key the store does not hold."""
        return wanted.join(self.holding(wanted).select(self.key), self.key, "left_anti")


def matching(store: DataFrame | BucketStore, wanted: DataFrame, key: str) -> DataFrame:
    """``wanted`` joined with a plain table or a bucket store on ``key``."""
    return store.matching(wanted) if isinstance(store, BucketStore) else wanted.join(store, key)


def missing(store: DataFrame | BucketStore, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` whose key a plain table or a bucket store does not hold."""
    if isinstance(store, BucketStore):
        return store.missing(wanted)
    return wanted.join(store.select(key), key, "left_anti")
