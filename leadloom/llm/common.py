"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Space and the five ASCII control characters that end a word (fixed by the result contracts).
WORD_BREAKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def row_key(id_col: str, text_col: str) -> Column:
    """Equal for rows with the same id and text, nulls included; such rows get the same verdicts."""
    return F.xxhash64(F.col(id_col), F.col(text_col).isNull(), F.col(text_col))


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
