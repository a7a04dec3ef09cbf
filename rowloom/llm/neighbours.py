"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is put into the leaf it descends to. A query visits leaves best
bin first: a priority queue holds branches by the distance to their centres, and the nearest is opened next. How
many leaves a query opens is calibrated: sample queries are answered by brute force over all rows, and visits
widen until the wanted share of their true neighbours lies in opened leaves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowloom.llm.common import bounded_sample, matrix
from rowloom.session import settle

#: vectors that the tree is fitted on, and queries that calibrate it
SAMPLE, TRIALS = 20_000, 200
BRANCHES = 8
#: rows that a leaf should have, and sampled vectors that it must have
LEAF_ROWS, LEAF_SAMPLE = 400, 8
#: share of true neighbours that calibration must reach
RECALL = 0.97
#: rows of one block; larger leaves are cut into several
BLOCK = 2_000


@dataclass
class Tree:
    centres: list[np.ndarray] = field(default_factory=list)
    #: per node its children, empty for a leaf
    children: list[list[int]] = field(default_factory=list)
    leaf_of: dict[int, int] = field(default_factory=dict)
    visits: int = 1
    counts: list[int] = field(default_factory=list)

    def leaves(self) -> int:
        return len(self.leaf_of)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each vector descends to, by the nearest child at every node."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not self.children[node]:
                out[rows] = self.leaf_of[node]
                continue
            near = _squared(x[rows], self.centres[node]).argmin(1)
            todo += [(child, rows[near == k]) for k, child in enumerate(self.children[node])]
        return out

    def best_bins(self, q: np.ndarray) -> Iterator[int]:
        """Leaves by a best-bin-first walk."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield self.leaf_of[node]
                continue
            for d, child in zip(_squared(q[None], self.centres[node])[0].tolist(), self.children[node]):
                heapq.heappush(queue, (d, child))

    def opened(self, q: np.ndarray, least: int) -> list[int]:
        """The leaves of the calibrated visits, and more while they hold fewer than ``least`` rows."""
        out, rows = [], 0
        for leaf in self.best_bins(q):
            if len(out) >= self.visits and rows >= least:
                break
            out.append(leaf)
            rows += self.counts[leaf]
        return out


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    near = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        near = _squared(x, centres).argmin(1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres, _squared(x, centres).argmin(1)


def fit(x: np.ndarray, leaf: int, seed: int = 8) -> Tree:
    """A tree whose leaves have about ``leaf`` of the sampled vectors; equal vectors stay in one leaf."""
    rng, tree = np.random.default_rng(seed), Tree()

    def grow(rows: np.ndarray) -> int:
        node = len(tree.children)
        tree.children.append([])
        tree.centres.append(np.zeros((0, x.shape[1])))
        part = x[rows]
        if len(rows) > leaf and (part != part[0]).any():
            centres, near = _kmeans(part, min(BRANCHES, -(-len(rows) // leaf) if len(rows) < leaf * BRANCHES else BRANCHES), rng)
            used = np.unique(near)
            if len(used) > 1:
                tree.centres[node] = centres[used]
                tree.children[node] = [grow(rows[near == k]) for k in used]
                return node
        tree.leaf_of[node] = len(tree.leaf_of)
        return node

    grow(np.arange(len(x)))
    return tree


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return matrix(column, width).astype(np.float64)


def _top(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, distance) of each query's k nearest rows but its own; ties to the smaller id."""
    rough = _squared(q, x)
    out = []
    for i in range(len(q)):
        other = ids != query_ids[i]
        row = np.where(other, rough[i], np.inf)
        if other.sum() > k:
            # rounding of the fast form must not decide: all rows near the bound are measured exactly
            bound = np.partition(row, k - 1)[k - 1]
            pick = np.flatnonzero(row <= bound + 1e-9 * (1 + bound + rough[i].max()))
        else:
            pick = np.flatnonzero(other)
        exact = np.sqrt(((x[pick] - q[i]) ** 2).sum(1))
        best = np.lexsort((ids[pick], exact))[:k]
        out.append((np.full(len(best), query_ids[i]), ids[pick][best], exact[best]))
    return tuple(np.concatenate([o[j] for o in out]) if out else np.zeros(0) for j in range(3))


NEAR = "query_id bigint, vec_id bigint, score double"


def _near_batch(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(found[0].astype(np.int64)), pa.array(found[1].astype(np.int64)), pa.array(found[2].astype(np.float64))], ["query_id", "vec_id", "score"]
    )


def _nearest(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def _brute(rows: DataFrame, query_ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """Exact neighbours of a bounded number of queries: each task keeps its own best, then the best of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0), np.zeros(0), np.zeros(0)]
        for batch in batches:
            found = _top(batch.column("vec_id").to_numpy(), _vectors(batch.column("vector"), q.shape[1]), query_ids, q, k)
            held = [np.concatenate([a, b]) for a, b in zip(held, found)]
            order = np.lexsort((held[1], held[2], held[0]))
            held = [a[order] for a in held]
            first = np.concatenate([[0], np.flatnonzero(held[0][1:] != held[0][:-1]) + 1]) if len(held[0]) else np.zeros(0, int)
            place = np.arange(len(held[0])) - np.repeat(first, np.diff(np.append(first, len(held[0]))))
            held = [a[place < k] for a in held]
        yield _near_batch(tuple(held))

    return _nearest(rows.select("vec_id", "vector").mapInArrow(run, NEAR), k)


def usable(rows: DataFrame, *, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """(vec_id, vector) of the rows that take part, and the number of components.

    Out are null ids, null vectors, zero vectors, vectors with a null or non-finite component, and
    those of another length than most have.
    """
    base = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    base = base.where("vec_id is not null and vector is not null").where(finite & F.exists("vector", lambda x: x != 0.0))
    width = base.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return (base.where(F.size("vector") == width["n"]), width["n"]) if width else (base, 0)


def search(rows: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", every: int = 100, k: int = 10, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every row whose id is divisible by ``every``.

    Distances are Euclidean, in double precision, on the vectors as they are; ties go to the smaller id. A query's own
    id is no candidate; with fewer than k candidates all are found. Rows that repeat an id are one row, that with
    the smallest vector. An empty table gives no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    base, width = usable(rows, id_column=id_column, vector_column=vector_column)
    if not width:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    base = settle(base.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    n = base.count()
    seen = bounded_sample(base, F.col("vec_id"), SAMPLE).orderBy("vec_id").toArrow()
    x = _vectors(seen.column("vector").combine_chunks(), width)
    ids = seen.column("vec_id").to_numpy()
    leaf = max(LEAF_SAMPLE, -(-LEAF_ROWS * len(x) // n))
    tree = fit(x, leaf)
    shape = spark.sparkContext.broadcast(tree)

    @F.arrow_udf("int")
    def place(column: pa.Array) -> pa.Array:
        return pa.array(shape.value.place(_vectors(column, width)).astype(np.int32))

    placed = settle(base.select("vec_id", "vector", place("vector").alias("leaf")), "placed")
    counts = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}
    tree.counts = [counts.get(leaf, 0) for leaf in range(tree.leaves())]
    tree.visits = _calibrated(placed, tree, ids, x, k, recall)
    walk = spark.sparkContext.broadcast(tree)

    @F.arrow_udf("array<int>")
    def opened(column: pa.Array) -> pa.Array:
        return pa.array([walk.value.opened(q, k + 1) for q in _vectors(column, width)], pa.list_(pa.int32()))

    # as many blocks a leaf as its rows need; there are no more leaves than the sample allows
    blocks = F.broadcast(spark.createDataFrame([(leaf, -(-c // BLOCK)) for leaf, c in counts.items()], "leaf int, blocks int"))
    members = placed.join(blocks, "leaf").select(
        "leaf", F.expr("cast(pmod(xxhash64(vec_id), blocks) as int)").alias("block"), F.lit(0).alias("side"), "vec_id", "vector"
    )
    asked = placed.where(F.col("vec_id") % every == 0).select("vec_id", "vector", F.explode(opened("vector")).alias("leaf")).join(blocks, "leaf")
    asked = asked.select("leaf", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(1).alias("side"), "vec_id", "vector")
    met = members.unionByName(asked).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "side")
    return _nearest(met.mapInArrow(_matcher(width, k), NEAR), k).select("query_id", "rank", "vec_id", "score")


def _calibrated(placed: DataFrame, tree: Tree, ids: np.ndarray, x: np.ndarray, k: int, recall: float) -> int:
    """Visits with which the sample queries have their share of true neighbours in opened leaves."""
    pick = np.random.default_rng(1).choice(len(x), min(TRIALS, len(x)), replace=False)
    truth = _brute(placed, ids[pick], x[pick], k).join(placed.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").toPandas()
    order = {int(i): {leaf: n for n, leaf in enumerate(tree.best_bins(q))} for i, q in zip(ids[pick], x[pick])}
    needed = np.array([order[q][leaf] + 1 for q, leaf in zip(truth["query_id"], truth["leaf"])])
    return max(1, int(np.quantile(needed, recall, method="higher"))) if len(needed) else 1


def _matcher(width: int, k: int):
    """Blocks arrive sorted, rows before queries; only the rows of one block are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, parts = None, [], []
        x: np.ndarray | None = None
        for batch in batches:
            leaf, block, side = (batch.column(c).to_numpy() for c in ("leaf", "block", "side"))
            vec, vector = batch.column("vec_id").to_numpy(), _vectors(batch.column("vector"), width)
            change = np.flatnonzero((leaf[1:] != leaf[:-1]) | (block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1
            edges = [0, *change.tolist(), len(leaf)] if len(leaf) else []
            for a, b in zip(edges, edges[1:]):
                if current != (leaf[a], block[a]):
                    current, ids, parts, x = (leaf[a], block[a]), [], [], None
                if side[a] == 0:
                    ids.append(vec[a:b])
                    parts.append(vector[a:b])
                elif parts:
                    if x is None:
                        held, x = np.concatenate(ids), np.concatenate(parts)
                    for c in range(a, b, 256):
                        yield _near_batch(_top(held, x, vec[c : min(c + 256, b)], vector[c : min(c + 256, b)], k))

    return run
