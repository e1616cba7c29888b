"""Additive schema sync: add missing columns, never drop or retype."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def default_for(field: T.StructField, as_of: datetime | None = None) -> Column:
    """NULL for a nullable column, else the default of its type, else NULL."""
    kind = field.dataType
    now = F.lit(as_of) if as_of is not None else F.current_timestamp()
    if field.nullable:
        value = F.lit(None)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        value = now
    elif isinstance(kind, T.StringType):
        value = F.lit("")
    elif isinstance(kind, T.BooleanType):
        value = F.lit(False)
    elif isinstance(kind, (T.IntegralType, T.FractionalType)):
        value = F.lit(0)
    else:
        value = F.lit(None)
    return value.cast(kind)


def sync_schema(df: DataFrame, target: T.StructType, as_of: datetime | None = None) -> DataFrame:
    """``df`` plus the columns of ``target`` that it lacks, in one projection."""
    present = set(df.columns)
    added = [default_for(f, as_of).alias(f.name) for f in target.fields if f.name not in present]
    return df.select("*", *added) if added else df


def sync_table(spark: SparkSession, path: str, target: T.StructType, new_path: str,
               as_of: datetime | None = None) -> DataFrame:
    """Write a new version of a Parquet table; the old files stay untouched."""
    if new_path.rstrip("/") == path.rstrip("/"):
        raise ValueError("write the new version to its own folder")
    sync_schema(spark.read.parquet(path), target, as_of).write.parquet(new_path)
    return spark.read.parquet(new_path)
