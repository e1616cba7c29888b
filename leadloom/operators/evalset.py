"""Labelled evaluation sets: accuracy, best candidate, split, demonstrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_context(scenarios: DataFrame, **constants: str) -> DataFrame:
    """Labelled set: scenarios (url, page_text, decision) plus shared context columns."""
    return scenarios.withColumns({k: F.lit(v) for k, v in constants.items()})


def same_decision(predicted: Column, gold: Column) -> Column:
    """Exact match after trim and upper-case; a missing side is wrong."""
    return F.coalesce(F.upper(F.trim(predicted)) == F.upper(F.trim(gold)), F.lit(False))


def scored(predictions: DataFrame, gold: DataFrame, key: str = "url") -> DataFrame:
    return predictions.withColumnRenamed("decision", "predicted").join(
        gold.select(key, F.col("decision").alias("gold")), key
    ).withColumn("correct", same_decision(F.col("predicted"), F.col("gold")))


def decision_accuracy(predictions: DataFrame, gold: DataFrame, key: str = "url") -> DataFrame:
    return scored(predictions, gold, key).groupBy("candidate").agg(
        F.count("*").alias("n"), F.count_if("correct").alias("n_correct"),
    ).withColumn("accuracy", F.round(F.col("n_correct") / F.col("n"), 6))


def confusion_counts(predictions: DataFrame, gold: DataFrame, key: str = "url") -> DataFrame:
    upper = lambda c: F.upper(F.trim(c))
    return scored(predictions, gold, key).groupBy(
        "candidate", upper("gold").alias("gold"), upper("predicted").alias("predicted")).agg(F.count("*").alias("n"))


def best_candidate(accuracy: DataFrame) -> DataFrame:
    """Highest accuracy; the lower candidate number wins a tie."""
    return accuracy.agg(F.max_by(F.struct("candidate", "accuracy"), F.struct(
        F.col("accuracy"), -F.col("candidate"))).alias("best")).select("best.*")


def train_split(examples: DataFrame, key: str = "url", n_train: int = 3) -> DataFrame:
    """Mark the first ``n_train`` examples as train and the rest as dev."""
    first = examples.select(key).orderBy(key).limit(n_train).withColumn("__train", F.lit(True))
    # At most n_train rows, hence safe to send everywhere.
    return examples.join(F.broadcast(first), key, "left").withColumn(
        "split", F.when(F.col("__train"), "train").otherwise("dev")).drop("__train")


def select_demos(predictions: DataFrame, gold: DataFrame, key: str = "url", max_demos: int = 3) -> DataFrame:
    """At most ``max_demos`` correctly answered examples per candidate."""
    order = Window.partitionBy("candidate").orderBy(key)
    return (scored(predictions, gold, key).where("correct").withColumn("demo", F.row_number().over(order))
            .where(F.col("demo") <= max_demos).select("candidate", "demo", key, "gold"))
