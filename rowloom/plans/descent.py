"""Perceptrons fitted by full-batch gradient descent: what Spark ML's ``gd`` solver computes, in array arithmetic.

Rows are packed once into blocks that stay cached; a pass multiplies whole blocks in the tasks and adds the
gradient up piece by piece, so what reaches the driver is one gradient a pass, whatever the number of tasks. Start weights,
the mean of block means, step, stopping and the model are Spark's. Weights and sums are double precision, the products
inside a block single precision, so the weights differ from Spark's by rounding: by less than 1e-5 of the way
they went from the start weights, in the tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.operators.columns import col

#: rows multiplied at once (more if a block has more), and weights that one reducer adds up at once
CHUNK_ROWS, PIECE = 512, 8192


def _matrices(weights: np.ndarray, layers: list[int], dtype: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(inputs x outputs, bias) of each layer, as Spark lays them out in one vector."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((weights[at : at + a * b].reshape(a, b).astype(dtype), weights[at + a * b : at + a * b + b].astype(dtype)))
        at += a * b + b
    return out


def _forward(x: np.ndarray, net: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Outputs of all layers: logistic units, class probabilities at the end."""
    out = []
    with np.errstate(over="ignore"):
        for w, b in net[:-1]:
            x = x @ w
            x += b
            np.negative(x, out=x)
            np.exp(x, out=x)
            x += 1
            np.reciprocal(x, out=x)
            out.append(x)
    w, b = net[-1]
    x = x @ w
    x += b
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return [*out, x]


def _backward(x: np.ndarray, outputs: list[np.ndarray], delta: np.ndarray, net: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The gradient of all weights, as one vector, from the error behind the last layer."""
    parts = []
    for k in range(len(net) - 1, -1, -1):
        below = outputs[k - 1] if k else x
        parts += [delta.sum(axis=0, dtype="float64"), (below.T @ delta).ravel()]
        if k:
            delta = delta @ net[k][0].T
            delta *= below
            np.subtract(1, below, out=below)
            delta *= below
    return np.concatenate(parts[::-1])


def _packed(rows: DataFrame, features: int, classes: int, block: int) -> DataFrame:
    """(x, y, w): features, classes and weights of some blocks as bytes.

    A partition's rows are cut into blocks in order, the last may be short; a row weighs one over the rows of its block.
    """
    chunk = max(1, min(CHUNK_ROWS, (1 << 20) // (8 * max(features, 1))) // block) * block

    def packed(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        w = np.full(len(x), 1.0 / block)
        short = len(x) % block
        if short:
            w[len(x) - short :] = 1.0 / short
        cells = [np.ascontiguousarray(x).tobytes(), y.astype("int32").tobytes(), w.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], ["x", "y", "w"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys = np.empty((0, features)), np.empty(0)
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False).astype("float64")
            # a missing label is NaN here
            bad = ~((y >= 0) & (y < classes) & (y == np.floor(y)))
            if bad.any():
                raise ValueError(f"labels are 0 to {classes - 1}, not {y[bad][0]}")
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
            if not np.isfinite(x).all():
                raise ValueError("features must be finite")
            xs, ys = np.concatenate([xs, x]), np.concatenate([ys, y])
            while len(xs) >= chunk:
                yield packed(xs[:chunk], ys[:chunk])
                xs, ys = xs[chunk:], ys[chunk:]
        if len(xs):
            yield packed(xs, ys)

    return rows.mapInArrow(pack, "x binary, y binary, w binary")


def _gradient(blocks: DataFrame, weights: np.ndarray, layers: list[int]) -> np.ndarray:
    """The sum over all rows, by their weights."""
    size, features = len(weights), layers[0]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, total = _matrices(weights, layers, "float32"), np.zeros(size)
        for batch in batches:
            for x, y, w in zip(*(batch.column(c) for c in ("x", "y", "w"))):
                x = np.frombuffer(x.as_buffer(), "float64").reshape(-1, features).astype("float32")
                y, w = np.frombuffer(y.as_buffer(), "int32"), np.frombuffer(w.as_buffer(), "float64").astype("float32")
                outputs = _forward(x, net)
                delta = outputs[-1]
                delta[np.arange(len(y)), y] -= 1
                delta *= w[:, None]
                total += _backward(x, outputs, delta, net)
        pieces = [total[a : a + PIECE].tobytes() for a in range(0, size, PIECE)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], ["piece", "g"])

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(g, "float64") for g in rows["g"])
        return pd.DataFrame({"piece": rows["piece"].iloc[:1], "g": [total.tobytes()]})

    found = blocks.mapInArrow(sums, "piece int, g binary").groupBy("piece").applyInPandas(merged, "piece int, g binary")
    # the weights' own size
    return np.concatenate([np.frombuffer(r["g"], "float64") for r in sorted(found.collect(), key=lambda r: r["piece"])])


def fit(estimator: MultilayerPerceptronClassifier, rows: DataFrame) -> MultilayerPerceptronClassificationModel:
    """What ``estimator.fit(rows)`` gives with the solver ``gd``."""
    layers, block = list(estimator.getLayers()), estimator.getBlockSize()
    step, tol = estimator.getStepSize(), estimator.getTol()
    # no iteration is run, so these are the weights that the seed draws
    start = estimator.copy({estimator.maxIter: 0})
    model = start.fit(rows.limit(1))
    weights = model.weights.toArray()
    cells = [vector_to_array(col(estimator.getFeaturesCol())).alias("x"), col(estimator.getLabelCol()).cast("double").alias("y")]
    blocks = _packed(rows.select(*cells), layers[0], layers[-1], block).persist()
    try:
        n = blocks.agg(F.sum(F.ceil(F.length("y") / 4 / block))).first()[0]
        for i in range(estimator.getMaxIter() if n else 0):
            before, weights = weights, weights - step * (_gradient(blocks, weights, layers) / n)
            if i and np.linalg.norm(before - weights) < tol * max(np.linalg.norm(weights), 1.0):
                break
    finally:
        blocks.unpersist()
    return start.setInitialWeights(Vectors.dense(weights)).fit(rows.limit(1))


def probabilities(model: MultilayerPerceptronClassificationModel, features: str = "features") -> Column:
    """Class probabilities of each row as an array, double precision, a batch at a time."""
    weights, layers = model.weights.toArray(), list(model.getLayers())

    @F.arrow_udf("array<double>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = _matrices(weights, layers, "float64")
        for x in batches:
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, layers[0])
            out = np.concatenate([_forward(x[a : a + CHUNK_ROWS], net)[-1] for a in range(0, len(x), CHUNK_ROWS)] or [np.empty((0, layers[-1]))])
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype="int32") * layers[-1]), pa.array(out.ravel()))

    return scored(vector_to_array(col(features)))
