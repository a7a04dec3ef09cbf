"""op3: toxicity of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.llm import toxicity
from rowloom.llm.common import fold

FOLDS, HELD_OUT = 4, 2


def op3_toxicity(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")


QUERIES = {"op3_toxicity": op3_toxicity}
SQL = {}
