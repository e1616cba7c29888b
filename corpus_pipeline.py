"""The corpus pipeline: quality rules, near-dedup, secret masking, packing; each stage reads what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadloom.llm import neardup, packing, quality, secrets
from leadloom.llm.entries import tokenizer_path
from leadloom.session import discard, write_scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all rules; the others go. Null and empty texts fail (fewer than 50 words)."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8 or more on five-word shingles, the one with the smallest doc_id."""
    return neardup.keep_one_per_group(docs, shingle=5, similarity=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets are masked, and n_chars is set anew where the text has changed."""
    return secrets.redact(docs, length_col="n_chars")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place there."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("secret scans", secret_scan),
          ("best-fit packing", best_fit_packing)]

#: SimHash votes and tokenizer ids have no SQL form; tests/llm/test_pipeline.py holds run() on a small
#: table against plain Python: rules, exact groups, masks, pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = write_scratch(docs, "stage")
            discard(before)
    return docs
