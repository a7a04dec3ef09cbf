"""Stored column sketches: distinct counts, shared levels and routing for a table that arrives in slices.

A slice is read once; what stays of it is a row per column with its row count, its NULL count and a theta sketch of
its levels (at most 16 * 2**log_k bytes or so, whatever the slice holds). Sketches of any slices merge into the
very sketch of their rows together, in any order, so counts over a day, a month or everything read small rows only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators.categories import distinct_counts
from rowloom.operators.columns import col

#: 2**14 hashes a sketch; a relative deviation of 0.8 %
LOG_K = 14
#: deviations that bounds are wide; a count is outside of them once in 16,000 columns
WIDTH = 4.0
SCHEMA = "col string, rows long, nulls long, sketch binary, log_k int, slice string"


def deviation(log_k: int = LOG_K) -> float:
    """Relative standard deviation of a count from ``2**log_k`` levels on; smaller counts are exact."""
    return 1 / math.sqrt(2**log_k - 2)


def column_sketches(df: DataFrame, cols: Sequence[str], log_k: int = LOG_K, by: str | None = None) -> DataFrame:
    """(slice, col, rows, nulls, sketch, log_k) of every column, in one scan without multiplying rows.

    Levels are texts, as in the encoders: the empty text and NaN are levels, NULL is not. ``by`` names the slice
    column; without it there is one slice, named by the empty text. A table without rows has no slices, unless
    ``by`` is None: then it has one with 0 rows.
    """
    if not cols:
        raise ValueError("no columns to sketch")
    # sketches pass over empty texts, so every level gets a letter in front
    level = {c: F.concat(F.lit("="), col(c).cast("string")) for c in cols}
    cells = [
        F.struct(
            F.lit(c).alias("col"), F.count(F.lit(1)).alias("rows"), F.count_if(col(c).isNull()).alias("nulls"),
            F.theta_sketch_agg(level[c], log_k).alias("sketch"), F.lit(log_k).alias("log_k"),
        )
        for c in cols
    ]
    keys = [] if by is None else [F.coalesce(col(by).cast("string"), F.lit("")).alias("slice")]
    rows = df.groupBy(*keys).agg(F.array(*cells).alias("_cells"))
    name = F.col("slice") if keys else F.lit("").alias("slice")
    return rows.select(name, F.inline("_cells"))


def merged(sketches: DataFrame, by: Sequence[str] = (), log_k: int = LOG_K) -> DataFrame:
    """Sketches of the same column merged into one; ``by`` keeps further columns apart. Smaller ones raise."""
    small = F.raise_error(F.lit(f"sketches smaller than 2**{log_k}")).cast("binary")
    sized = F.when(F.col("log_k") < log_k, small).otherwise(F.col("sketch"))
    return sketches.groupBy("col", *by).agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.theta_union_agg(sized, log_k).alias("sketch"),
    )


def estimates(sketches: DataFrame, log_k: int = LOG_K) -> DataFrame:
    """(col, rows, nulls, n_distinct, low, high, exact) over all given slices.

    Below ``2**log_k`` levels the count is exact but for equal 64-bit hashes; beyond it the true number lies between ``low``
    and ``high`` (four standard deviations). Sketches of another size than ``log_k`` can't be merged and raise.
    """
    k = F.lit(2**log_k)
    sized = merged(sketches, log_k=log_k).select("col", "rows", "nulls", F.theta_sketch_estimate("sketch").alias("n_distinct"))
    # a sketch that has dropped hashes states at least 2**log_k
    exact = F.col("n_distinct") < k
    off = F.lit(WIDTH * deviation(log_k))
    return sized.select(
        "col", "rows", "nulls", "n_distinct",
        F.when(exact, F.col("n_distinct")).otherwise(F.floor(F.col("n_distinct") / (1 + off))).alias("low"),
        F.when(exact, F.col("n_distinct")).otherwise(F.ceil(F.col("n_distinct") / (1 - off))).alias("high"),
        exact.alias("exact"),
    )


def level_overlap(left: DataFrame, right: DataFrame, log_k: int = LOG_K) -> DataFrame:
    """(col, left_levels, right_levels, shared, unseen): ``unseen`` levels of ``right`` that ``left`` has not.

    Encoders fitted on ``left`` meet that many levels they don't know. Exact while both columns have under ``2**log_k`` levels.
    """
    left = merged(left, log_k=log_k).select("col", F.col("sketch").alias("_a"))
    both = left.join(merged(right, log_k=log_k).select("col", F.col("sketch").alias("_b")), "col")
    size = F.theta_sketch_estimate
    return both.select(
        "col", size("_a").alias("left_levels"), size("_b").alias("right_levels"),
        size(F.theta_intersection("_a", "_b")).alias("shared"), size(F.theta_difference("_b", "_a")).alias("unseen"),
    )


def route_by_sketch(
    sketches: DataFrame, cols: Sequence[str], threshold: int = 3, rows: DataFrame | None = None, log_k: int = LOG_K
) -> tuple[list[str], list[str]]:
    """Columns with at least ``threshold`` levels, and the others, both sorted, without reading the rows.

    A column whose bounds hold the threshold is counted exactly on ``rows``; without them it raises.
    """
    found = {r["col"]: r for r in estimates(sketches.where(F.col("col").isin(list(cols))), log_k).collect()}
    high, low, open_ = [], [], []
    for c in sorted(set(cols)):
        bounds = (found[c]["low"], found[c]["high"]) if c in found else (0, 0)
        (high if bounds[0] >= threshold else low if bounds[1] < threshold else open_).append(c)
    if open_ and rows is None:
        raise ValueError(f"sketches can't tell whether {open_} have {threshold} levels: give the rows")
    if open_:
        for r in distinct_counts(rows, open_).collect():
            (high if r["n_distinct"] >= threshold else low).append(r["col"])
    return sorted(high), sorted(low)


class SketchStore:
    """Sketches by slice. Writing a slice again replaces it, so a job that is run twice counts once."""

    def __init__(self, spark: SparkSession, root: str, log_k: int = LOG_K):
        self.spark, self.log_k = spark, log_k
        self.path = f"{root.rstrip('/')}/sketches"

    def add(self, df: DataFrame, cols: Sequence[str], by: str | None = None, name: str | None = None) -> None:
        """Read ``df`` once and keep its sketches, as slice ``name`` or as the slices that column ``by`` tells."""
        if (by is None) == (name is None):
            raise ValueError("name the slice, or the column that tells slices")
        found = column_sketches(df, cols, self.log_k, by)
        if name is not None:
            found = found.withColumn("slice", F.lit(name))
        (
            found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("slice").parquet(self.path)
        )

    def load(self, slices: Sequence[str] | None = None) -> DataFrame:
        """The sketches of some slices, or of all; only files of these slices are read."""
        table = self.spark.read.schema(SCHEMA).parquet(self.path)
        # a partition without a name reads as NULL
        table = table.withColumn("slice", F.coalesce("slice", F.lit("")))
        return table if slices is None else table.where(F.col("slice").isin(list(slices)))

    def estimates(self, slices: Sequence[str] | None = None) -> DataFrame:
        return estimates(self.load(slices), self.log_k)

    def overlap(self, left: Sequence[str], right: Sequence[str]) -> DataFrame:
        return level_overlap(self.load(left), self.load(right), self.log_k)

    def route(self, cols: Sequence[str], threshold: int = 3, rows: DataFrame | None = None) -> tuple[list[str], list[str]]:
        return route_by_sketch(self.load(), cols, threshold, rows, self.log_k)
