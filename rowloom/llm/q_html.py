"""op10: main text of all pages."""

from __future__ import annotations

from rowloom.llm.html import extract


def op10_html_extraction(spark, sf):
    return extract(spark.read.parquet(f"{sf}/pages.parquet"))


QUERIES = {"op10_html_extraction": op10_html_extraction}
SQL = {}
