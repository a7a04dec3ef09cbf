"""op6: quality of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.llm import quality
from rowloom.llm.common import fold

FOLDS, HELD_OUT = 3, 1


def fitted(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    return quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels, label="quality")


def op6_quality_classifier(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scored = quality.score(docs, fitted(spark, sf))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
SQL = {}
