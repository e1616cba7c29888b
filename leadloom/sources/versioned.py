"""A keyed table in versions: an update rewrites the buckets that it touches, older versions stay readable.

Layout: ``<path>/data/version=<v>/bucket=<b>/…`` holds the buckets that version
v wrote, ``<path>/manifest/<v>.json`` says for every bucket in which version
its rows lie. A reader takes one manifest and sees the table of that version,
whatever is written meanwhile. A version counts from the moment its manifest is
there; what a failed writer left is overwritten by the next attempt.

One writer at a time. A version that exists isn't written again, so a repeated
streaming batch changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from leadloom.session import write_scratch
from leadloom.sources.buckets import MOST_BUCKETS, bucket_of

Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class VersionedStore:
    """``key``: column that a row is found by; ``buckets`` must not change once a version is written."""

    spark: SparkSession
    path: str
    schema: T.StructType
    key: str
    buckets: int = 32

    def __post_init__(self):
        if not 0 < self.buckets <= MOST_BUCKETS:
            raise ValueError(f"between 1 and {MOST_BUCKETS} buckets")

    # --- manifests

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest/{version:010d}.json"

    def versions(self) -> list[int]:
        """All written versions, ascending."""
        fs, folder = self._fs(f"{self.path}/manifest")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _places(self, version: int | None) -> dict[int, int]:
        if version is None:
            return {}
        text = self.spark.read.text(self._manifest(version), wholetext=True).first()["value"]
        return {int(b): v for b, v in json.loads(text).items()}

    def _commit(self, version: int, places: dict[int, int]) -> None:
        fs, temporary = self._fs(f"{self.path}/manifest/_{version:010d}")
        _, final = self._fs(self._manifest(version))
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps({str(b): v for b, v in sorted(places.items())}).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(temporary, final):
            raise RuntimeError(f"version {version} of {self.path} was written by someone else")

    # --- reading

    def latest(self) -> int | None:
        return max(self.versions(), default=None)

    def _read(self, places: dict[int, int]) -> DataFrame:
        folders = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(places.items())]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The table as of a version; as of the latest by default, empty if there is none."""
        return self._read(self._places(self.latest() if version is None else version))

    # --- writing

    def update(self, changes: DataFrame, merge: Merge, version: int | None = None) -> int:
        """Write the next version: ``merge(rows of the touched buckets, changes)`` gives the new rows of those buckets.

        ``changes`` has the key column; its buckets are the touched ones, of
        which at most ``buckets`` numbers reach the driver. No changes give a
        version that equals the one before.
        """
        before = self.latest()
        version = (0 if before is None else before + 1) if version is None else version
        if before is not None and version <= before:
            return before  # a repeated batch
        places = self._places(before)
        changes = write_scratch(changes, "changes")
        touched = {r["b"] for r in changes.select(bucket_of(F.col(self.key), self.buckets).alias("b")).distinct().collect()}
        if touched:
            old = self._read({b: v for b, v in places.items() if b in touched})
            rows = merge(old, changes).select(*self.schema.names).withColumn("bucket", bucket_of(F.col(self.key), self.buckets))
            folder = f"{self.path}/data/version={version}"
            rows.repartition("bucket").sortWithinPartitions("bucket", self.key).write.mode("overwrite").partitionBy("bucket").parquet(folder)
            fs, where = self._fs(folder)
            names = [s.getPath().getName() for s in fs.listStatus(where)]
            filled = {int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")}
            places = {b: v for b, v in places.items() if b not in touched} | {b: version for b in filled}
        self._commit(version, places)
        return version

    def forget(self, keep: Sequence[int]) -> None:
        """Delete the manifests of all versions but ``keep`` (and the latest), and the buckets that no kept one holds."""
        wanted = {*keep, self.latest()}
        held = {(v, b) for version in wanted if version is not None for b, v in self._places(version).items()}
        for version in self.versions():
            if version not in wanted:
                fs, where = self._fs(self._manifest(version))
                fs.delete(where, False)
            fs, folder = self._fs(f"{self.path}/data/version={version}")
            if not fs.exists(folder):
                continue
            for status in fs.listStatus(folder):
                name = status.getPath().getName()
                if name.startswith("bucket=") and (version, int(name.removeprefix("bucket="))) not in held:
                    fs.delete(status.getPath(), True)
