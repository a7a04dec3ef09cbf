"""Exact quantiles with linear interpolation, for columns and groups of any size, by recursive brackets.

A wanted rank lies in an open bracket, at first the whole line. A bracket of at most ``small_rows`` values is
sorted in one task. A larger one is cut at a few of its own values, picked by a sketch; an exact count of what
lies between the cuts, and on each of them, tells the cut or the smaller bracket that holds the rank. A sketch
that is off only makes that bracket larger: the cuts are values, so every round leaves fewer of them, ties go
at once, and nothing is ever widened. Counts are added up in the tasks that read the rows, and only what lies
inside brackets is written for the next round. The input is computed once, whatever the number of rounds; the
brackets of columns are few and kept on the driver, those of groups are a table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.operators.columns import col
from rowloom.operators.joins import lookup
from rowloom.session import settle

SMALL_ROWS = 2_000_000
ACCURACY = 10_000
#: parts that later rounds cut a bracket into
PARTS = 64


def _present(x: Column) -> Column:
    return F.when(~F.isnan(x.cast("double")), x.cast("double"))


def column_quantiles(
    df: DataFrame,
    wanted: dict[str, Sequence[float]],
    where: dict[str, Column] | None = None,
    small_rows: int = SMALL_ROWS,
    accuracy: int = ACCURACY,
) -> dict[str, list[float] | None]:
    """Quantiles of several columns at once; None for a column without values.

    NaN is missing, like NULL, whatever the number of rows.
    ``where`` restricts single columns to the rows that meet a condition.

    ``df`` is computed once: its numbers are written, and every round reads these. Cuts, counts per cell and
    brackets are as many as quantiles ask for, so the driver holds them; values stay in the tasks.
    """
    where = where or {}
    if not wanted:
        return {}
    every = sorted({q for qs in wanted.values() for q in qs})
    cells = [_present(F.when(where[n], col(n)) if n in where else col(n)).alias(f"v{i}") for i, n in enumerate(wanted)]
    wide = settle(df.select(*cells), "values")
    row = wide.agg(*[F.count(c).alias(c) for c in wide.columns]).first()
    sizes = {i: row[f"v{i}"] for i in range(len(wanted)) if row[f"v{i}"]}
    if max(sizes.values(), default=0) <= small_rows:
        long = wide.select(F.explode(F.array(*[F.struct(F.lit(i).alias("g"), F.col(f"v{i}").alias("v")) for i in range(len(wanted))])).alias("c"))
        # as many rows as columns
        rows = long.select("c.g", "c.v").where("v is not null").groupBy("g").agg(F.percentile("v", every).alias("q")).collect()
        found = {r["g"]: r["q"] for r in rows}
    else:
        at = {i: [q * (n - 1) for q in every] for i, n in sizes.items()}
        values = _at_ranks(wide, {i: sorted({r for x in xs for r in (math.floor(x), math.ceil(x))}) for i, xs in at.items()}, sizes, every, small_rows, accuracy)

        def quantile(i: int, x: float) -> float:
            low, high = values[i, math.floor(x)], values[i, math.ceil(x)]
            return low + (0.0 if x == math.floor(x) else (high - low) * (x - math.floor(x)))

        found = {i: [quantile(i, x) for x in xs] for i, xs in at.items()}
    place = {q: i for i, q in enumerate(every)}
    return {n: [found[i][place[q]] for q in qs] if i in found else None for i, (n, qs) in enumerate(wanted.items())}


@dataclass
class _Bracket:
    """Values of a column strictly between two of its own, ``before`` others below them, and the ranks that lie there."""

    column: int
    low: float | None
    high: float | None
    before: int
    ranks: list[int]
    cell: int = 0
    rows: int = 0


def _at_ranks(
    wide: DataFrame, ranks: dict[int, list[int]], sizes: dict[int, int], probs: Sequence[float], small_rows: int, accuracy: int
) -> dict[tuple[int, int], float]:
    """The value at each 0-based rank of each column, of so many values: (column, rank) -> value."""
    brackets = [_Bracket(i, None, None, 0, rs) for i, rs in ranks.items()]
    # the sketches are merged pairwise by Spark and give a few cuts a column
    row = wide.agg(*[F.percentile_approx(f"v{i}", _around(probs, accuracy, sizes[i]), accuracy).alias(f"e{i}") for i in ranks]).first()
    cuts, rows, found = {i: row[f"e{i}"] for i in ranks}, wide, {}
    while brackets:
        edges = {i: np.unique(np.array(c, dtype="float64")) for i, c in cuts.items()}
        hit, brackets = _narrowed(brackets, edges, _cell_counts(rows, edges))
        found |= hit
        if not brackets:
            break
        rows = settle(_inside(rows, edges, brackets), "inside")
        few = [b for b in brackets if b.rows <= small_rows]
        if few:
            found |= _sorted_values(rows, few)
        brackets = [b for b in brackets if b.rows > small_rows]
        if brackets:
            # fine enough for the parts, so that each round leaves a small share of a bracket
            parts, fine = [i / PARTS for i in range(PARTS + 1)], max(accuracy, 10 * PARTS)
            kept = F.broadcast(rows.sparkSession.createDataFrame([(b.column, b.cell) for b in brackets], "c int, cell int"))
            rows = rows.join(kept, ["c", "cell"], "left_semi")
            cuts = {b.column: [] for b in brackets}
            for b in brackets:
                cuts[b.column] += [x for x in (b.low, b.high) if x is not None]
            for r in rows.groupBy("c", "cell").agg(F.percentile_approx("v", parts, fine).alias("e")).collect():
                cuts[r["c"]] += r["e"]
    return found


def _tools():
    """``parts`` and ``cells``, made here so that they travel with the functions that use them."""

    def parts(batch):
        """(column number, its values) of a batch with a column each, or with rows (c, cell, v)."""
        if "cell" in batch.schema.names:
            c, v = batch.column("c").to_numpy(), batch.column("v").to_numpy()
            yield from ((int(i), v[c == i]) for i in np.unique(c))
        else:
            for i, x in enumerate(batch.columns):
                x = x.to_numpy(zero_copy_only=False)
                yield i, x[~np.isnan(x)]

    def cells(edges, v):
        """Odd cells are the edges, even ones lie between them."""
        at = np.searchsorted(edges, v)
        return 2 * at + (edges[np.minimum(at, len(edges) - 1)] == v)

    return parts, cells


def _cell_counts(rows: DataFrame, edges: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Rows per cell of each column; tasks add up, Spark merges."""
    parts, cells = _tools()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {i: np.zeros(2 * len(e) + 1, dtype="int64") for i, e in edges.items()}
        for batch in batches:
            for i, v in parts(batch):
                if i in edges:
                    sums[i] += np.bincount(cells(edges[i], v), minlength=len(sums[i]))
        for i, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), i, dtype="int32")), pa.array(at.astype("int32")), pa.array(n[at])], ["c", "cell", "n"]
            )

    out = {i: np.zeros(2 * len(e) + 1, dtype="int64") for i, e in edges.items()}
    # as many rows as cells
    for r in rows.mapInArrow(count, "c int, cell int, n long").groupBy("c", "cell").agg(F.sum("n").alias("n")).collect():
        out[r["c"]][r["cell"]] = r["n"]
    return out


def _narrowed(
    brackets: Sequence[_Bracket], edges: dict[int, np.ndarray], counts: dict[int, np.ndarray]
) -> tuple[dict[tuple[int, int], float], list[_Bracket]]:
    """The ranks that lie on an edge, with its value, and the cell of each other rank as a smaller bracket."""
    found, out = {}, []
    for b in brackets:
        e, n = edges[b.column], counts[b.column]
        first = 0 if b.low is None else 2 * int(np.searchsorted(e, b.low)) + 2
        last = len(n) - 1 if b.high is None else 2 * int(np.searchsorted(e, b.high))
        ends = b.before + np.cumsum(n[first : last + 1])
        held: dict[int, _Bracket] = {}
        for rank in b.ranks:
            x = int(np.searchsorted(ends, rank, side="right"))
            cell = first + x
            if cell % 2:
                found[b.column, rank] = float(e[cell // 2])
                continue
            if cell not in held:
                low = float(e[cell // 2 - 1]) if cell > 0 else None
                high = float(e[cell // 2]) if cell // 2 < len(e) else None
                held[cell] = _Bracket(b.column, low, high, int(ends[x] - n[cell]), [], cell, int(n[cell]))
            held[cell].ranks.append(rank)
        out += held.values()
    return found, out


def _inside(rows: DataFrame, edges: dict[int, np.ndarray], brackets: Sequence[_Bracket]) -> DataFrame:
    """(c, cell, v): the values that lie in a bracket, with its cell."""
    wanted = {i: np.unique([b.cell for b in brackets if b.column == i]) for i in {b.column for b in brackets}}
    parts, cells = _tools()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, v in parts(batch):
                if i in wanted:
                    cell = cells(edges[i], v)
                    mine = np.isin(cell, wanted[i])
                    c = np.full(int(mine.sum()), i, dtype="int32")
                    yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(cell[mine].astype("int32")), pa.array(v[mine])], ["c", "cell", "v"])

    return rows.mapInArrow(keep, "c int, cell int, v double")


def _sorted_values(rows: DataFrame, brackets: Sequence[_Bracket]) -> dict[tuple[int, int], float]:
    """Values at the ranks of brackets that one task can sort each."""
    places = [(b.column, b.cell, rank - b.before + 1, rank) for b in brackets for rank in b.ranks]
    places = rows.sparkSession.createDataFrame(places, "c int, cell int, place long, rank long")
    mine = rows.join(F.broadcast(places.select("c", "cell").distinct()), ["c", "cell"], "left_semi")
    numbered = mine.withColumn("place", F.row_number().over(Window.partitionBy("c", "cell").orderBy("v")).cast("long"))
    # as many rows as ranks
    return {(r["c"], r["rank"]): r["v"] for r in numbered.join(F.broadcast(places), ["c", "cell", "place"]).select("c", "rank", "v").collect()}


def group_quantiles(
    df: DataFrame,
    by: str,
    value: str,
    probs: Sequence[float],
    small_rows: int = SMALL_ROWS,
    accuracy: int = ACCURACY,
    spread_by: Column | None = None,
) -> DataFrame:
    """One row per group: ``by``, ``n`` and the array ``q`` of exact quantiles; NaN and NULL are missing."""
    rows = df.select(
        col(by).alias("g"), _present(col(value)).alias("v"),
        (spread_by if spread_by is not None else F.xxhash64(col(value))).alias("s"),
    ).where("g is not null and v is not null")
    return _quantiles(rows, list(probs), small_rows, accuracy).select(col("g").alias(by), "n", "q")


def _quantiles(rows: DataFrame, probs: Sequence[float], small_rows: int, accuracy: int) -> DataFrame:
    """``(g, n, q)`` of rows ``(g, v, s)``; ``s`` spreads the rows of a hot group."""
    counts = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 0
    if most <= small_rows:
        return rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.percentile("v", list(probs)).alias("q"))
    # every round reads the rows
    rows = settle(rows, "rows")
    counts = settle(counts, "counts")
    at = F.array(*[F.lit(q) * (F.col("n") - 1) for q in probs])
    ranks = F.array_distinct(F.flatten(F.transform(at, lambda x: F.array(F.floor(x), F.ceil(x)))))
    none = F.lit(None).cast("double")
    state = counts.select("g", F.explode(ranks).alias("rank"), none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("before"))
    # groups are cut at the same shares: close ones for the largest, and some for those that are just over the bound
    found, shares = None, sorted({*_around(probs, accuracy, most), *_around(probs, accuracy, small_rows)})
    while True:
        values, state, rows = _round(rows, state, shares, small_rows, accuracy)
        found = values if found is None else found.unionByName(values)
        if state is None:
            break
        # fine enough for the parts, so that each round leaves a small share of a bracket
        shares, accuracy = [i / PARTS for i in range(PARTS + 1)], max(accuracy, 10 * PARTS)
    at_rank = F.map_from_entries(F.collect_list(F.struct("rank", "value")))
    picked = found.groupBy("g").agg(at_rank.alias("m")).join(counts, "g")

    def quantile(x: Column) -> Column:
        low, high = F.col("m")[F.floor(x)], F.col("m")[F.ceil(x)]
        return low + F.when(F.floor(x) == F.ceil(x), F.lit(0.0)).otherwise((high - low) * (x - F.floor(x)))

    return picked.select("g", "n", F.transform(at, quantile).alias("q"))


def _around(probs: Sequence[float], accuracy: int, rows: int) -> list[float]:
    """Shares a little to both sides of the wanted ones: the sketch's error, plus ranks of ``rows`` that rounding can move."""
    slack = 3.0 / accuracy + 2.0 / max(rows, 1)
    return sorted({min(max(q + d, 0.0), 1.0) for q in probs for d in (-slack, slack)})


def _placed(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows inside some bracket of their group, with the bracket's ``low`` and ``high``."""
    spans = state.groupBy("g").agg(F.collect_set(F.struct("low", "high")).alias("spans"), F.max("weight").alias("weight"))
    met = lookup(rows, spans, ["g"], ["spans"], "weight", F.col("s"))
    inside = F.filter(
        "spans", lambda b: F.coalesce(F.col("v") > b["low"], F.lit(True)) & F.coalesce(F.col("v") < b["high"], F.lit(True))
    )
    return met.withColumn("b", F.get(inside, F.lit(0))).where("b is not null").select("g", "v", "s", "b.low", "b.high")


def _round(rows, state, shares, small_rows, accuracy):
    """Values (g, rank, value) that this round settles, the brackets (None if none is left) and the rows inside them."""
    key = ["g", "low", "high"]

    def joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        renamed = right.select(*[F.col(k).alias(f"_{k}") for k in key], *[c for c in right.columns if c not in key])
        same = F.col("g").eqNullSafe(F.col("_g"))
        for k in key[1:]:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return left.join(renamed, same, how).drop(*[f"_{k}" for k in key])

    weights = rows.groupBy("g").agg(F.count(F.lit(1)).alias("weight"))
    weighted = state.join(weights, "g")
    placed = _placed(rows, weighted)
    sketch = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("m"), F.percentile_approx("v", shares, accuracy).alias("cuts"))
    sketch = sketch.withColumn("cuts", F.when(F.col("m") > small_rows, F.array_distinct(F.array_sort("cuts"))))
    sketch = settle(sketch, "sketch")
    # brackets that one task can sort
    few = joined(placed, sketch.where("cuts is null").select(*key), "left_semi").groupBy(*key).agg(F.array_sort(F.collect_list("v")).alias("all"))
    values = joined(state, few).select("g", "rank", F.get("all", (F.col("rank") - F.col("before")).cast("int")).alias("value"))
    many = settle(joined(state, sketch.where("cuts is not null").select(*key, "cuts")), "brackets")
    if many.isEmpty():
        return settle(values, "values"), None, rows
    # the others are counted: odd cells are cuts, even ones lie between them
    cut = many.groupBy("g").agg(F.collect_set(F.struct("low", "high", "cuts")).alias("spans")).join(weights, "g")
    met = lookup(placed.select("g", "v", "s", "low", "high"), cut, ["g"], ["spans"], "weight", F.col("s"))
    mine = F.filter("spans", lambda b: b["low"].eqNullSafe(F.col("low")) & b["high"].eqNullSafe(F.col("high")))
    met = met.withColumn("cuts", F.get(mine, F.lit(0))["cuts"]).where("cuts is not null")
    cell = 2 * F.size(F.filter("cuts", lambda c: c < F.col("v"))) + F.array_contains("cuts", F.col("v")).cast("int")
    cells = met.groupBy(*key, cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*key).orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("end", F.sum("c").over(upto)).withColumn("start", F.col("end") - F.col("c"))
    at = joined(many, cells).where((F.col("rank") - F.col("before") >= F.col("start")) & (F.col("rank") - F.col("before") < F.col("end")))
    half = F.floor(F.col("cell") / 2).cast("int")
    at = settle(at.select(
        "g", "rank", (F.col("cell") % 2 == 1).alias("hit"), F.get("cuts", half).alias("value"),
        F.when(half > 0, F.get("cuts", half - 1)).otherwise(F.col("low")).alias("new_low"),
        F.coalesce(F.get("cuts", half), F.col("high")).alias("new_high"), (F.col("before") + F.col("start")).alias("before"),
    ), "ranks")
    values = settle(values.unionByName(at.where("hit").select("g", "rank", "value")), "values")
    left = at.where("not hit").select("g", "rank", F.col("new_low").alias("low"), F.col("new_high").alias("high"), "before")
    if left.isEmpty():
        return values, None, rows
    inside = settle(_placed(rows, left.join(weights, "g")).select("g", "v", "s"), "inside")
    return values, left, inside
