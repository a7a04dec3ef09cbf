"""Key joins: blocks of features side by side, and lookups of per-key statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.layout import DEFAULT, Layout
from rowloom.operators.columns import col
from rowloom.session import settle

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
_HOT_SHARE = 1000
_SPREAD = 1 << 16


def side_by_side(first: DataFrame, *blocks: DataFrame, on: str = "id") -> DataFrame:
    """Put feature blocks with the same ids next to each other.

    Every id must occur in every block, and once: a missing or repeated one fails the
    job instead of silently losing, padding or multiplying a row.
    """
    def once(block: DataFrame) -> DataFrame:
        # the window needs the rows by id, as the join does
        seen = F.count(F.lit(1)).over(Window.partitionBy(col(on)))
        repeated = F.raise_error(F.concat(F.lit("id repeats in a block: "), col(on).cast("string")))
        checked = F.when(F.col("_seen") == 1, col(on)).otherwise(repeated.cast(block.schema[on].dataType))
        return block.withColumn("_seen", seen).withColumn(on, checked).drop("_seen")

    out = once(first)
    for block in map(once, blocks):
        shared = (set(out.columns) & set(block.columns)) - {on}
        if shared:
            raise ValueError(f"blocks share columns: {sorted(shared)}")
        left = out.withColumn("_left", F.lit(1))
        right = block.withColumn("_right", F.lit(1))
        whole = F.col("_left").isNotNull() & F.col("_right").isNotNull()
        checked = F.when(whole, col(on)).otherwise(
            F.raise_error(F.concat(F.lit("id in one block only: "), col(on).cast("string")))
        )
        names = [c for c in out.columns if c != on] + [c for c in block.columns if c != on]
        out = left.join(right, on, "full").select(
            checked.cast(first.schema[on].dataType).alias(on), *[col(c) for c in names]
        )
    return out


def joined_to_itself(df: DataFrame, keys: DataFrame, right: Sequence[str], on: str) -> DataFrame:
    """What joining the other columns of ``df`` with its columns ``right`` by ``on`` gives.

    ``keys`` has the keys of ``df``'s rows. A key of one row has that row for a result, so only rows with a
    repeated key are moved; a row without a key has no result.
    """
    left = [c for c in df.columns if c != on and c not in right]
    many = keys.where(col(on).isNotNull()).groupBy(col(on)).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    many = settle(many.select(col(on)), "repeated", passing=True)
    out = df.where(col(on).isNotNull())
    if not many.isEmpty():
        # rows are computed once more for it
        again = settle(out.join(many, on, "left_semi"), "repeated", passing=True)
        pairs = again.select(col(on), *[col(c) for c in left]).join(again.select(col(on), *[col(c) for c in right]), on)
        out = out.join(many, on, "left_anti").unionByName(pairs)
    return out.select(col(on), *[col(c) for c in left], *[col(c) for c in right])


def attach_label(features: DataFrame, source: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """Bring the label of ``source`` to the feature rows with the same id."""
    return features.drop(layout.label).join(
        source.select(layout.id, layout.label), layout.id, "left"
    )


def small_copy(
    table: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame | None:
    """``table`` as a driver-held relation, or None if it is over the size bound.

    At most ``max_rows + 1`` rows are ever fetched, so the check itself is bounded.
    """
    fetched = table.limit(max_rows + 1).toArrow()
    if fetched.num_rows > max_rows or fetched.nbytes > max_bytes:
        return None
    return table.sparkSession.createDataFrame(fetched, schema=table.schema)


def small_or_settled(
    table: DataFrame, name: str, max_rows: int = BROADCAST_ROWS
) -> tuple[DataFrame, bool]:
    """A fitted table as driver-held copy if it is small, else written to the shared folder.

    The table is computed once for both the check and the write.
    """
    cached = table.persist()
    try:
        copy = small_copy(cached, max_rows)
        if copy is not None:
            return copy, True
        # sorted files let a later filter on the first column skip most pages
        return settle(cached.sortWithinPartitions(cached.columns[0]), name), False
    finally:
        cached.unpersist()


def lookup(
    df: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    values: Sequence[str],
    rows: str,
    spread_by: Column,
    small: bool | None = None,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left join ``df`` with a table that has one row per key.

    ``rows`` names the column of ``table`` that counts how often each key occurs.
    A table within the size bound is broadcast. A larger one is joined by shuffle,
    except for its hot keys: keys holding over 1/1000 of all rows are at most
    1000, so they are broadcast; their rows, and rows with a NULL key, are spread
    by ``spread_by`` over many partitions where nothing matches them.
    """
    on, values = list(on), list(values)
    slim = table.select(*[col(c) for c in on + values])
    if small is None:
        copy = small_copy(table, max_rows)
        if copy is not None:
            slim, small = copy.select(*[col(c) for c in on + values]), True
    if small:
        return df.join(F.broadcast(slim), on, "left")

    total = table.agg(F.sum(rows).alias("n")).first()["n"] or 0
    hot = table.where(col(rows) > total / _HOT_SHARE)
    hot = df.sparkSession.createDataFrame(hot.toArrow(), schema=table.schema).select(
        *[col(c) for c in on],
        *[col(v).alias(f"_hot_{v}") for v in values],
        F.lit(True).alias("_hot"),
    )
    no_match = F.col("_hot").isNotNull()
    for key in on:
        no_match = no_match | col(key).isNull()
    salt = F.when(no_match, F.pmod(F.xxhash64(spread_by), F.lit(_SPREAD)) + 1).otherwise(0)
    left = df.join(F.broadcast(hot), on, "left").withColumn("_salt", salt.cast("int"))
    joined = left.join(slim.withColumn("_salt", F.lit(0)), on + ["_salt"], "left")
    return joined.select(
        *[col(c) for c in df.columns],
        *[F.coalesce(col(f"_hot_{v}"), col(v)).alias(v) for v in values],
    )
