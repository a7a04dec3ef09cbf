"""op7: mix the sources of all documents to target weights."""

from __future__ import annotations

from rowloom.llm.mixing import mix


def op7_mixing(spark, sf):
    return mix(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op7_mixing": op7_mixing}
SQL = {}
