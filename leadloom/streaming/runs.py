"""Running a stream over what is available now and reading the result back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from leadloom.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_BATCH = "batch"


def with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(_BATCH, T.IntegerType())])


def use_rocksdb(spark: SparkSession) -> None:
    """Keep stream state on disk-backed RocksDB instead of the executor heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """File stream with the schema of the files that are there; NTZ times become instants.

    The path is given as a glob that matches just itself, because a plain
    stream path must be a folder and a table may also be a single file.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    ntz = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else stream


def run_each(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Hand every micro-batch of the available input to ``handle``."""
    query = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def run_append(stream: DataFrame, label: str) -> DataFrame:
    """Run to the end of the available input into a Parquet sink."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    query = (stream.writeStream.format("parquet").option("path", path)
             .option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, label: str, handle: Callable[[DataFrame, int], DataFrame] | None = None,
                mode: str = "append", path: str | None = None) -> DataFrame:
    """Write each micro-batch to its own ``batch=<id>`` folder.

    A repeated batch overwrites its own folder only, so a restart after a
    failure neither loses nor doubles rows. Returns all batches with ``batch``.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, label)
    written: dict[str, object] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = handle(batch, batch_id) if handle else batch
        written["schema"] = rows.schema
        rows.write.mode("overwrite").parquet(f"{path}/{_BATCH}={batch_id}")

    query = (stream.writeStream.outputMode(mode).foreachBatch(write)
             .option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    schema = written.get("schema", stream.schema)
    if not written:
        return spark.createDataFrame([], with_batch(schema))
    return spark.read.schema(with_batch(schema)).parquet(path)


def latest(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Last written row of each key (update mode)."""
    rest = [c for c in batches.columns if c not in (*keys, _BATCH)]
    return batches.groupBy(*keys).agg(F.max_by(F.struct(*rest), _BATCH).alias("r")).select(*keys, "r.*")


def last_batch(batches: DataFrame) -> DataFrame:
    """Rows of the last batch only (complete mode)."""
    last = batches.agg(F.max(_BATCH).alias("b")).first().b
    return batches.where(F.col(_BATCH) == F.lit(last)).drop(_BATCH)
