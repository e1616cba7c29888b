"""The next row by descending id, with ids that many rows share."""

import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import functions as F  # noqa: E402

from leadloom.llm import merkle  # noqa: E402
from leadloom.llm.common import row_key  # noqa: E402


def test_next_rows_of_shared_ids(spark):
    rng = random.Random(9)
    rows = [(None, f"none {k}") for k in range(150)] + [(7, f"seven {k}") for k in range(200)] + [(-1, f"m {k}") for k in range(40)]
    rows += [(rng.randint(0, 900), f"t{k}") for k in range(250)] + [(2**62, "top"), (-(2**62), "low"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keyed = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row_key("doc_id", "text").alias("k")).collect()
    order = sorted(keyed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.k), reverse=True)
    wanted = sorted(str((a.doc_id, a.text, b.text)) for a, b in zip(order, order[1:] + order[:1]))
    assert sorted(str(tuple(r)) for r in merkle.with_next(df).select("id", "text", "next_text").collect()) == wanted


def test_one_id_fills_several_slices(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 3000, F.lit(5)).otherwise(F.col("id")).alias("position"), F.xxhash64("id").alias("key"))
    pieces = 20
    q = df.select(F.percentile_approx("position", [i / pieces for i in range(1, pieces)], 10_000).alias("q")).first().q
    sizes = [r["count"] for r in df.groupBy(merkle._numbered_slice(sorted(q), pieces).alias("s")).count().collect()]
    assert max(sizes) < 350 and len(sizes) >= 18
