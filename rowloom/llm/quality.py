"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits shallow trees to one feature at a time; their sum is a lookup table per
feature. Then pairs of features get tables of their own. A text's score is a sum of
table entries at its bins, so scoring is a handful of array additions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm import words
from rowloom.llm.common import bounded_sample, logistic, text_batches

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper_share", "symbol_share", "mark_share", "pipe_share",
    "digit_share", "high_share", "break_share", "repeat_share", "distinct_share", "symbol_end_share",
    "upper_word_share", "long_word_share", "space_share",
)

_UPPER = words.char_class((65, 90))
_DIGIT = words.char_class((48, 57))
_HIGH = words.char_class((128, 255))
_BREAK = words.char_class((10, 10))
_SPACE = words.char_class((32, 32), (9, 13))
_PIPE = words.char_class((124, 124))
_PLAIN_MARK = words.char_class((44, 44), (46, 46))
_MARK = words.char_class((33, 33), (63, 63))
_SYMBOL = words.char_class((33, 47), (58, 64), (91, 96), (123, 126)) & ~_PLAIN_MARK


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES per text; an empty or null text has zeros."""
    out = np.zeros((len(column), len(FEATURES)))
    for first, last, data, offsets in words.slices(column):
        size = np.diff(offsets)
        starts, ends, firsts = words.spans(data, offsets, words.SPACED)
        count = np.diff(firsts)
        hashes = words.span_hashes(data, starts, ends)
        row = np.repeat(np.arange(last - first), count)
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        kinds, kind_rows = words.distinct_by_row(hashes, row)
        upper = np.concatenate([[0], np.cumsum(_UPPER[data], dtype=np.int64)])
        uppers = upper[ends] - upper[starts]
        per_word = lambda flags: _sums(flags, firsts) / np.maximum(count, 1)
        per_byte = lambda table: _sums(table[data], offsets) / np.maximum(size, 1)
        distinct = np.bincount(kind_rows, minlength=last - first)
        symbol_end = _SYMBOL[data[ends - 1]] if len(ends) else np.zeros(0, bool)
        out[first:last] = np.column_stack([
            np.log1p(size), np.log1p(count), _sums(ends - starts, firsts) / np.maximum(count, 1),
            per_byte(_UPPER), per_byte(_SYMBOL), per_byte(_MARK), per_byte(_PIPE), per_byte(_DIGIT), per_byte(_HIGH),
            per_byte(_BREAK), per_word(again), distinct / np.sqrt(np.maximum(2 * count, 1)), per_word(symbol_end),
            per_word((uppers >= 2) & (uppers * 2 >= ends - starts)), per_word(ends - starts > 20), per_byte(_SPACE),
        ])
    return out


@dataclass
class AdditiveModel:
    """Bin edges per feature, a table per feature, and a table per chosen pair."""

    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edges, x[:, j], side="right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], side="right") for pair in self.pairs for j in pair}
        for (a, b), table in zip(self.pairs, self.pair_tables):
            out += table[coarse[a], coarse[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.raw(x))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _steps(gradient: np.ndarray, weight: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values per bin of a shallow tree on ordered bins: the best split first, while it gains."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    fit = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)

    def best(a: int, b: int) -> tuple[float, int, int, int]:
        cut = np.arange(a + 1, b)
        if not len(cut):
            return 0.0, a, b, b
        gain = fit(a, cut) + fit(cut, b) - fit(a, b)
        k = int(gain.argmax())
        return float(gain[k]), a, b, int(cut[k])

    parts = [best(0, len(gradient))]
    while len(parts) < leaves:
        k = max(range(len(parts)), key=lambda i: parts[i][0])
        gain, a, b, cut = parts[k]
        if gain <= 1e-12:
            break
        parts[k : k + 1] = [best(a, cut), best(cut, b)]
    out = np.zeros(len(gradient))
    for _, a, b, _ in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def fit_additive(
    x: np.ndarray, y: np.ndarray, *, bins: int = 48, pair_bins: int = 8, rounds: int = 150, pair_rounds: int = 60,
    pairs: int = 6, leaves: int = 4, rate: float = 0.1, ridge: float = 1.0,
) -> AdditiveModel:
    """Cyclic boosting on the logistic loss; no rows give a model that always says one half."""
    n, width = x.shape if len(x) else (0, len(FEATURES))
    if n == 0:
        empty = [np.zeros(0)] * width
        return AdditiveModel(empty, 0.0, [np.zeros(1)] * width, [], empty, [])
    edges = [_edges(x[:, j], bins) for j in range(width)]
    codes = [np.searchsorted(edges[j], x[:, j], side="right") for j in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    share = (y.sum() + 0.5) / (n + 1)
    intercept = float(np.log(share / (1 - share)))
    raw = np.full(n, intercept)
    for _ in range(rounds):
        for j in range(width):
            if len(tables[j]) == 1:
                continue
            p = logistic(raw)
            step = rate * _steps(
                np.bincount(codes[j], y - p, len(tables[j])), np.bincount(codes[j], p * (1 - p), len(tables[j])), leaves, ridge
            )
            tables[j] += step
            raw += step[codes[j]]
    pair_edges = [_edges(x[:, j], pair_bins) for j in range(width)]
    coarse = [np.searchsorted(pair_edges[j], x[:, j], side="right") for j in range(width)]
    sizes = [len(e) + 1 for e in pair_edges]
    p = logistic(raw)
    gains = []
    for a in range(width):
        for b in range(a + 1, width):
            cell = coarse[a] * sizes[b] + coarse[b]
            g = np.bincount(cell, y - p, sizes[a] * sizes[b])
            h = np.bincount(cell, p * (1 - p), sizes[a] * sizes[b])
            gains.append((float((g * g / (h + ridge)).sum()), a, b))
    chosen = [(a, b) for _, a, b in sorted(gains, reverse=True)[:pairs]]
    pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in chosen]
    for _ in range(pair_rounds):
        for (a, b), table in zip(chosen, pair_tables):
            p = logistic(raw)
            cell = coarse[a] * sizes[b] + coarse[b]
            g = np.bincount(cell, y - p, table.size).reshape(table.shape)
            h = np.bincount(cell, p * (1 - p), table.size).reshape(table.shape)
            # a tree of depth two: cut along the one feature, then along the other in each part
            rows = _steps(g.sum(1), h.sum(1), 2, ridge)
            step = np.zeros_like(table)
            for value in np.unique(rows):
                part = rows == value
                step[part] = _steps(g[part].sum(0), h[part].sum(0), 2, ridge)
            table += rate * step
            raw += rate * step.ravel()[cell]
    return AdditiveModel(edges, intercept, tables, chosen, pair_edges, pair_tables)


def features_column(text: Column) -> Column:
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def measured(column: pa.Array) -> pa.Array:
        x = features(column)
        return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())

    return measured(text)


def fit(docs: DataFrame, labels: DataFrame, *, label: str, id_column: str = "doc_id", max_rows: int = 50_000) -> AdditiveModel:
    """Fit on at most ``max_rows`` labelled rows, those with the smallest hash of the id.

    Labels are 0 or 1; null labels and ids without a text row are left out. Only the
    features of the sample reach the driver.
    """
    text_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg(
        F.max(label).alias("_y")
    )
    sample = bounded_sample(known, F.col("_id"), max_rows)
    joined = docs.select(F.col(id_column).alias("_id"), F.col("text").alias("_text")).join(F.broadcast(sample), "_id")
    table = joined.select("_id", F.col("_y").cast("double"), features_column(F.col("_text")).alias("_x")).toArrow()
    if table.num_rows == 0:
        return fit_additive(np.zeros((0, len(FEATURES))), np.zeros(0))
    y = table.column("_y").to_numpy()
    x = np.stack(table.column("_x").combine_chunks().to_numpy(zero_copy_only=False))
    order = np.lexsort((*x.T, y, table.column("_id").to_numpy()))[:max_rows]
    return fit_additive(x[order], y[order])


def score_column(text: Column, model: AdditiveModel) -> Column:
    """Score in [0, 1] of a text column; null and empty texts have the score of zero features."""

    @F.arrow_udf(T.DoubleType())
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(model.score(features(column)))

    return scored(text)


def score(docs: DataFrame, model: AdditiveModel, *, id_column: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(id, score, predicted), a row for each of ``docs``; repeated rows stay, an empty table stays empty."""
    text_batches(docs.sparkSession)
    return docs.select(F.col(id_column), score_column(F.col("text"), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
