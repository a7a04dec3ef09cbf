"""Row numbers and running totals without one global sort.

A global order is cut into buckets by a monotone function of the order key. The
counts per bucket are a small table, so its running total is cheap; the order
inside a bucket is a window over that bucket only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.scalars import order_hash
from rowloom.operators.columns import col


def shuffled_rank(
    df: DataFrame,
    id_col: str,
    seed: int,
    partition: Sequence[str] = (),
    out: str = "rank",
    prefix: int = 4,
) -> DataFrame:
    """0-based rank of every row in a seeded random order, per ``partition``.

    The random order is that of an md5 text; its first ``prefix`` hex digits
    (16**prefix buckets of even size, whatever the ids look like) are the bucket.
    The bucket counts are hash-partitioned like the window, so adding the offsets
    moves no row of ``df`` a second time.
    """
    keys = [f"_key{i}" for i in range(len(partition))]
    hashed = df.withColumns(
        {
            # a text key without NULL, so that rows with no label join too
            **{
                k: F.coalesce(F.concat(F.lit("="), col(p).cast("string")), F.lit("null"))
                for k, p in zip(keys, partition)
            },
            "_hash": order_hash(seed, col(id_col)),
        }
    ).withColumn("_bucket", F.substring("_hash", 1, prefix))
    cell = [*keys, "_bucket"]

    before = Window.partitionBy(*keys, F.lit(0)).orderBy("_bucket")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy(*cell)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*cell).orderBy("_hash", col(id_col))
    ranked = hashed.withColumn("_row", F.row_number().over(inside) - 1)
    return ranked.join(offsets, cell).select(
        *[col(c) for c in df.columns], (F.col("_offset") + F.col("_row")).alias(out)
    )


#: rows that a bucket should hold, and the fewest and most buckets
BUCKET_ROWS, BUCKETS = 200_000, (64, 65_536)


def sketch_edges(df: DataFrame, name: str, buckets: int | None = None) -> list[float]:
    """Distinct cut points that split the values of ``name`` into even buckets, roughly.

    Without ``buckets`` there are as many as the rows need, from the least of BUCKETS on: rows are counted
    first, and only the cut points that are needed are asked for. Beyond the most of BUCKETS they grow on,
    with the accuracy of the sketch, so a bucket stays within reach of a task.
    """
    x = col(name).cast("double")
    if buckets is None:
        rows = df.where(x.isNotNull()).count()
        buckets = min(max(BUCKETS[0], -(-rows // BUCKET_ROWS)), BUCKETS[1])
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    return sorted(set(df.agg(F.percentile_approx(x, shares, 10 * buckets).alias("e")).first()["e"] or []))


def bucket_columns(df: DataFrame, edges: dict[str, list[float]], prefix: str) -> DataFrame:
    """Add ``prefix + name``: how many edges are at or below the value (a binary search).

    A missing value gets a bucket number of its own, past the last one.
    """
    # infinite values are in the outermost buckets anyway
    edges = {n: [x for x in e if abs(x) != float("inf")] for n, e in edges.items()}
    plain = {n: e for n, e in edges.items() if not e}
    cut = {n: e for n, e in edges.items() if e}
    out = df.withColumns({prefix + n: F.lit(0) for n in plain}) if plain else df
    if cut:
        # adding 0.0 turns -0.0 into 0.0, which the search would tell apart
        doubles = {f"_x_{prefix}{n}": col(n).cast("double") + F.lit(0.0) for n in cut}
        out = out.withColumns(doubles)
        splits = [[float("-inf"), *(x + 0.0 for x in e), float("inf")] for e in cut.values()]
        out = Bucketizer(
            splitsArray=splits,
            inputCols=list(doubles),
            outputCols=[prefix + n for n in cut],
            handleInvalid="keep",
        ).transform(out)
        out = out.withColumns({prefix + n: col(prefix + n).cast("int") for n in cut})
        out = out.drop(*doubles)
    return out


def running_extreme(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    value: str,
    direction: str,
    out: str,
    buckets: int | None = None,
) -> DataFrame:
    """Best value so far along ``order`` inside each ``by`` group, NULLs skipped.

    The order key is bucketed, so one long group is worked on by many tasks.
    """
    best = F.max if direction == "maximize" else F.min
    outer = F.greatest if direction == "maximize" else F.least
    by = list(by)
    keyed = bucket_columns(df, {order: sketch_edges(df, order, buckets)}, "_b_")
    cell = [*by, f"_b_{order}"]
    before = Window.partitionBy(*by).orderBy(f"_b_{order}")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        keyed.groupBy(*cell)
        .agg(best(col(value)).alias("_v"))
        .select(*cell, best("_v").over(before).alias("_before"))
    )
    inside = Window.partitionBy(*cell).orderBy(order)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = keyed.withColumn("_inside", best(col(value)).over(inside))
    return ranked.join(heads, cell).select(
        *[col(c) for c in df.columns], outer("_inside", "_before").alias(out)
    )


def average_ranks(df: DataFrame, name: str, buckets: int | None = None, count: str | None = None) -> DataFrame:
    """(value, rows, rank): each distinct value of a column with its 1-based rank, ties sharing their average.

    Values are counted first and the counts are bucketed, so no task holds the order of the whole column.
    NaN is missing, like NULL. With ``count``, a row stands for as many as that column says.
    """
    x = col(name).cast("double")
    n = F.sum(col(count) if count else F.lit(1))
    counts = df.where(x.isNotNull() & ~F.isnan(x)).groupBy((x + F.lit(0.0)).alias("value")).agg(n.alias("rows"))
    cut = bucket_columns(counts, {"value": sketch_edges(counts, "value", buckets)}, "_b_")
    earlier = Window.partitionBy(F.lit(0)).orderBy("_b_value").rowsBetween(Window.unboundedPreceding, -1)
    # a row a bucket
    heads = cut.groupBy("_b_value").agg(F.sum("rows").alias("_n")).select("_b_value", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_b_value").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_before") + F.coalesce(F.sum("rows").over(inside), F.lit(0))
    return cut.join(heads, "_b_value").select("value", "rows", (below + (F.col("rows") + 1) / 2).alias("rank"))
