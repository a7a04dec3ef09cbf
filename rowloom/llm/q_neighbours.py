"""op8: nearest neighbours among all embeddings."""

from __future__ import annotations

from rowloom.llm.neighbours import search


def op8_nearest_neighbours(spark, sf):
    return search(spark.read.parquet(f"{sf}/embeddings.parquet"))


QUERIES = {"op8_nearest_neighbours": op8_nearest_neighbours}
SQL = {}
