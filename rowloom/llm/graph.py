"""Connected components of an edge table, by contraction; labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.session import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge (a, b); the component is its smallest node.

    Each round every node moves to its smallest neighbour if that is smaller, and edges are
    rewritten between the new names. Only nodes without a smaller neighbour remain, at most
    half of each component, so the rounds are logarithmic in the size of the largest one. Self
    loops, repeated edges, nulls and an empty table are fine (a null end is no edge).
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a < b")
    edges = settle(edges.distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_p")).select("node", F.least("node", "_p").alias("parent")), "parents")
        # follow one more step, so that chains shrink faster
        up = parent.select(F.col("node").alias("_n"), F.col("parent").alias("_up"))
        parent = settle(parent.join(up, F.col("parent") == F.col("_n")).select("node", F.col("_up").alias("parent")), "parents")
        maps.append(parent)
        low = parent.select(F.col("node").alias("a"), F.col("parent").alias("_a"))
        high = parent.select(F.col("node").alias("b"), F.col("parent").alias("_b"))
        renamed = edges.join(low, "a").join(high, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        edges = settle(renamed.where("a < b").distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0].withColumnRenamed("parent", "component")
    for step in maps[1:]:
        out = out.join(step.select(F.col("node").alias("_n"), F.col("parent").alias("_p")), F.col("component") == F.col("_n"), "left").select(
            "node", F.coalesce("_p", "component").alias("component")
        )
    return settle(out, "components")
