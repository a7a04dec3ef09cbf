"""Mix sources to target weights with exact budgets; DataFrame and SQL functions only.

Every document gets a hash-random key. Sources are cut into key ranges, ranges are
counted, a prefix sum over the counts gives each range's offset, and a window inside each
range finishes the prefix sum, so no task holds a whole source. A source is taken as many
whole times as fit its budget, and the rest up to the exact word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowloom.session import settle

#: rows of one key range, on average
RANGE_ROWS = 5_000
#: ranges whose counts one window task adds up, on average
GROUP_RANGES = 1_000
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
_KEY_BITS = 40
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words between spaces and the control characters tab to return; null has none.

    Every word becomes one character and the separators go, so no list of words is built.
    """
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, _WORD, "w"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources in code point order, null last, have the weights in turn. Together they get
    all words; a target stops at ``most`` times its source's size, and what is over goes to the
    others by weight. Sources sorted by size over weight reach their limit one after another, so the
    common level is the first that leaves the next source below its limit. Rows here are sources.
    """
    named = W.orderBy(F.col("source").isNull(), "source")
    listed = sizes.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    ).withColumn("_limit", F.lit(float(most)) * F.col("source_size"))
    rank = W.orderBy(F.col("_limit") / F.col("weight"), F.col("source").isNull(), "source")
    everything = W.partitionBy()
    before = rank.rowsBetween(W.unboundedPreceding, -1)
    level = listed.withColumn(
        "_level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
        / F.sum("weight").over(rank.rowsBetween(0, W.unboundedFollowing)),
    )
    # sources up to the first whose limit is above its level stop at the limit
    open_ = F.col("_limit") / F.col("weight") >= F.col("_level")
    common = F.min_by(F.when(open_, F.col("_level")), F.when(open_, F.col("_limit") / F.col("weight"))).over(everything)
    return level.select(
        "source", "source_size",
        F.coalesce(F.least("_limit", common * F.col("weight")), F.col("_limit")).cast("double").alias("target"),
    )


def mix(
    docs: DataFrame, *, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 7,
) -> DataFrame:
    """(id, size, source, source_size, target, taken), a row for each of ``docs``.

    ``taken`` counts the words the mix takes of a document, repeats included: whole passes,
    and a last one that is cut at the word where the budget ends. The order of that pass is the
    hash of id and seed, then the id, so reruns agree. Rows that repeat an id and its text share
    a key and are cut one after another in an order that no result depends on. A null or empty
    text has size and taken 0; a null source is a source; an empty table gives no rows.
    Other columns of ``docs`` are neither read nor returned.
    """
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 64 - _KEY_BITS)
    sized = settle(
        docs.select(
            F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), word_count(F.col(text_column)).alias("size")
        ).withColumn("_key", key),
        "mixing",
    )
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    totals = settle(by_source, "mixing-sources")
    goal = targets(totals.select("source", "source_size"), weights, most).join(
        totals.select(F.col("source").alias("_s"), "_rows"), F.col("source").eqNullSafe(F.col("_s"))
    ).drop("_s")
    # as many ranges as a source of that many rows needs
    ranges = F.greatest(F.lit(1), F.ceil(F.col("_rows") / RANGE_ROWS)).cast("long")
    plan = settle(goal.withColumn("_ranges", ranges).withColumnRenamed("source", "_s"), "mixing-targets")
    placed = sized.join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn(
        "_range", F.expr(f"cast(floor(_key * _ranges / {1 << _KEY_BITS}D) as bigint)")
    )
    counted = settle(
        placed.groupBy("source", "_range").agg(F.sum("size").alias("_words"))
        .withColumn("_group", F.expr(f"cast(_range div {GROUP_RANGES} as bigint)")),
        "mixing-ranges",
    )
    # two levels, so that not even the ranges of one source meet in a single task
    before = W.partitionBy("source").orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    groups = counted.groupBy("source", "_group").agg(F.sum("_words").alias("_w")).select(
        F.col("source").alias("_gs"), F.col("_group").alias("_gg"), F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_group_offset")
    )
    inside = W.partitionBy("source", "_group").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counted.withColumn("_offset", F.coalesce(F.sum("_words").over(inside), F.lit(0))).join(
        groups, F.col("source").eqNullSafe(F.col("_gs")) & (F.col("_group") == F.col("_gg"))
    ).select(
        F.col("source").alias("_s"), F.col("_range").alias("_r"), (F.col("_offset") + F.col("_group_offset")).alias("_offset")
    )
    running = W.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    summed = placed.withColumn("_before", F.coalesce(F.sum("size").over(running), F.lit(0))).join(
        offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))
    )
    budget = F.round("target").cast("long")
    passes = F.expr("case when source_size > 0 then cast(round(target) as bigint) div source_size else 0 end").cast("long")
    rest = budget - passes * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before") - F.col("_offset")))
    return summed.select(
        "doc_id", "size", "source", "source_size", "target", (passes * F.col("size") + last).cast("long").alias("taken")
    )
