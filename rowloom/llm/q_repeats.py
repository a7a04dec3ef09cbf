"""op1: repeated byte strings of all documents."""

from __future__ import annotations

from rowloom.llm.repeats import removed

#: the last two columns count repeated passages of over 50 words, also those under the 400 bytes of strings that go;
#: both numbers are those of the pipeline's stage
PASSAGE_BYTES, PASSAGE_WORDS = 240, 51


def op1_suffix_array_dedup(spark, sf):
    return removed(spark.read.parquet(f"{sf}/documents.parquet"), short=PASSAGE_BYTES, least_words=PASSAGE_WORDS)


QUERIES = {"op1_suffix_array_dedup": op1_suffix_array_dedup}
SQL = {}
