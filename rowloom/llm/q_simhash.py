"""op11: components of documents whose fingerprints differ in few bits."""

from __future__ import annotations

from rowloom.llm.simhash import fuzzy_duplicates


def op11_simhash_golay(spark, sf):
    return fuzzy_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))


QUERIES = {"op11_simhash_golay": op11_simhash_golay}
#: SQL has no XXH64; tests/llm compares with brute force
SQL = {}
