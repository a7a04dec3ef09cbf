"""Unions and the way back from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.layout import DEFAULT, TEST, TRAIN, Layout


def union_lenient(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by name; a column one side lacks is NULL there."""
    out = first
    for other in others:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def union_strict(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union of tables with equal column names and types; anything else is an error."""
    expected = {f.name: f.dataType for f in first.schema}
    out = first
    for other in others:
        found = {f.name: f.dataType for f in other.schema}
        if found != expected:
            odd = sorted(set(found.items()) ^ set(expected.items()), key=str)
            raise ValueError(f"schemas differ: {odd}")
        out = out.unionByName(other)
    return out


def tag_union(train: DataFrame, test: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """One table out of train and test rows, told apart by the split column."""
    return union_lenient(
        train.withColumn(layout.split, F.lit(TRAIN)), test.withColumn(layout.split, F.lit(TEST))
    )


def split_back(df: DataFrame, layout: Layout = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Train and test part of a tagged table; the test part has no label."""
    train = df.where(F.col(layout.split) == TRAIN).drop(layout.split)
    test = df.where(F.col(layout.split) == TEST).drop(layout.split, layout.label)
    return train, test
