"""Labelled documents as a gold set for candidate decision rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.catalog.registry import query
from leadloom.operators import evalset as V
from leadloom.sources.tables import read_table


def gold(spark, sf):
    """Quality labels as gold decisions of the labelled documents."""
    labels = read_table(spark, sf, "labels")
    decision = F.when(F.col("toxic") == 1, " prune ").when(F.col("quality") == 1, "CONVERT").otherwise("FOLLOW")
    docs = read_table(spark, sf, "documents", ["doc_id", "source"])
    joined = labels.join(docs, "doc_id").select("doc_id", F.col("source").alias("url"), decision.alias("decision"))
    return V.with_context(joined, target_intent="find partners", memory_buffer="INITIAL_QUERY")


def predictions(spark, sf):
    """Four candidate rules over length, language and source, for every document."""
    docs = read_table(spark, sf, "documents", ["doc_id", "lang", "source", "n_chars"])
    rules = [
        F.lit("convert"),
        F.when(F.col("n_chars") > 1500, "CONVERT").otherwise("FOLLOW"),
        F.when(F.col("lang") == "en", " Convert").otherwise("PRUNE"),
        F.when(F.col("source") < "src5", "FOLLOW").otherwise("convert "),
    ]
    every = F.array(*[F.struct(F.lit(i).cast("bigint").alias("candidate"), rule.alias("decision"))
                      for i, rule in enumerate(rules)])
    return docs.select("doc_id", F.explode(every).alias("r")).select("doc_id", "r.*")


_GOLD = """
gold AS (SELECT l.doc_id, CASE WHEN toxic = 1 THEN ' prune ' WHEN quality = 1 THEN 'CONVERT' ELSE 'FOLLOW' END AS decision
         FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
predictions AS (SELECT doc_id, CAST(candidate AS BIGINT) AS candidate, CASE candidate WHEN 0 THEN 'convert'
    WHEN 1 THEN CASE WHEN n_chars > 1500 THEN 'CONVERT' ELSE 'FOLLOW' END
    WHEN 2 THEN CASE WHEN lang = 'en' THEN ' Convert' ELSE 'PRUNE' END
    ELSE CASE WHEN source < 'src5' THEN 'FOLLOW' ELSE 'convert ' END END AS predicted
  FROM documents, (SELECT unnest([0, 1, 2, 3]) AS candidate)),
scored AS (SELECT candidate, g.doc_id, upper(trim(g.decision)) AS gold, upper(trim(predicted)) AS predicted,
    upper(trim(g.decision)) = upper(trim(predicted)) AS correct, g.decision AS raw_gold
  FROM gold g JOIN predictions p ON g.doc_id = p.doc_id),
accuracy AS (SELECT candidate, count(*) AS n, count(*) FILTER (WHERE correct) AS n_correct,
    round(count(*) FILTER (WHERE correct) / count(*), 6) AS accuracy FROM scored GROUP BY candidate)"""


@query("decision_accuracy", f"WITH {_GOLD} SELECT candidate, n, n_correct, accuracy FROM accuracy")
def decision_accuracy(spark, sf):
    return V.decision_accuracy(predictions(spark, sf), gold(spark, sf), "doc_id")


@query("decision_confusion", f"WITH {_GOLD} SELECT candidate, gold, predicted, count(*) AS n FROM scored GROUP BY ALL")
def decision_confusion(spark, sf):
    return V.confusion_counts(predictions(spark, sf), gold(spark, sf), "doc_id")


@query("best_candidate", f"WITH {_GOLD} SELECT candidate, accuracy FROM accuracy ORDER BY accuracy DESC, candidate LIMIT 1")
def best_candidate(spark, sf):
    return V.best_candidate(V.decision_accuracy(predictions(spark, sf), gold(spark, sf), "doc_id"))


@query("train_split", f"""WITH {_GOLD}
SELECT doc_id, decision, 'find partners' AS target_intent, CASE WHEN row_number() OVER (ORDER BY doc_id) <= 3 THEN 'train' ELSE 'dev' END
  AS split FROM gold""")
def train_split(spark, sf):
    return V.train_split(gold(spark, sf), "doc_id").select("doc_id", "decision", "target_intent", "split")


@query("demo_select", f"""WITH {_GOLD}
SELECT candidate, doc_id, raw_gold AS gold, demo FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY doc_id) AS demo
FROM scored WHERE correct) WHERE demo <= 3""")
def demo_select(spark, sf):
    return V.select_demos(predictions(spark, sf), gold(spark, sf), "doc_id").withColumn(
        "demo", F.col("demo").cast("bigint"))
