"""Seeded fold assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.layout import DEFAULT, TRAIN, Layout
from rowloom.operators.columns import col
from rowloom.operators.ordering import shuffled_rank


def _assign(df, k, seed, layout, stratify, prefix):
    if k < 2:
        raise ValueError("at least two folds are needed")
    tagged = layout.split in df.columns
    keys = ([layout.split] if tagged else []) + ([layout.label] if stratify else [])
    ranked = shuffled_rank(df.drop(layout.fold), layout.id, seed, keys, "_rank", prefix)
    fold = (F.col("_rank") % k).cast("int")
    if tagged:
        fold = F.when(col(layout.split) == TRAIN, fold)
    return ranked.withColumn(layout.fold, fold).drop("_rank")


def stratified_folds(
    df: DataFrame, k: int = 5, seed: int = 42, layout: Layout = DEFAULT, prefix: int = 4
) -> DataFrame:
    """Add a fold number; every label is spread evenly, sizes differ by at most one.

    Test rows of a tagged table get no fold.
    """
    return _assign(df, k, seed, layout, True, prefix)


def plain_folds(
    df: DataFrame, k: int = 5, seed: int = 42, layout: Layout = DEFAULT, prefix: int = 4
) -> DataFrame:
    """Add a fold number without regard to the label (for continuous labels)."""
    return _assign(df, k, seed, layout, False, prefix)
