"""Registered queries of this package, with SQL where SQL can state them."""

from __future__ import annotations

import importlib

MODULES = ["q_mixing", "q_quality", "q_decontaminate", "q_minhash", "q_repeats", "q_toxicity", "q_html", "q_warc", "q_neighbours", "q_language", "q_simhash", "q_collocations", "q_conversations"]


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        merged.update(getattr(importlib.import_module(f"rowloom.llm.{name}"), attribute))
    return merged


QUERIES = _merged("QUERIES")
SQL = _merged("SQL")
