"""op2: language of all pages."""

from __future__ import annotations

from rowloom.llm.language import identify


def op2_language_id(spark, sf):
    return identify(spark.read.parquet(f"{sf}/pages.parquet"), spark.read.parquet(f"{sf}/documents.parquet"))


QUERIES = {"op2_language_id": op2_language_id}
SQL = {}
