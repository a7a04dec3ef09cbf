"""Registered queries and the SQL that states their results independently."""

from __future__ import annotations

import importlib

MODULES = ["tables", "profile", "features", "scores", "recipes", "models"]


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"catalog.{name}"), attribute)
        twice = merged.keys() & part.keys()
        if twice:
            raise ValueError(f"registered twice: {sorted(twice)}")
        merged.update(part)
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")


def flagship(spark, sf):
    from catalog.models import flagship as run

    return run(spark, sf)
