"""Stacking and weighted blending of stored predictions."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions import metrics
from rowloom.functions.scalars import hash_uniform, ratio
from rowloom.layout import DEFAULT, Layout
from rowloom.operators.columns import col, sql_text
from rowloom.operators.numeric import Standardizer
from rowloom.session import settle


def meta_features(
    preds: DataFrame, model_ids: Sequence[str], labels: DataFrame | None = None,
    features: DataFrame | None = None, scale: bool = False, classes: int = 2,
    layout: Layout = DEFAULT,
) -> DataFrame:
    """One row per id with a column (or one per class) for each model's prediction.

    ``preds`` is long: model_id, id, split, and ``pred`` as number or array. Scaling is
    learnt from train rows. A feature table and the labels are joined by id.
    """
    ids = list(model_ids)
    rows = preds.where(F.col("model_id").isin(ids))
    wide = rows.groupBy(layout.id, layout.split).agg(
        *[F.max(F.when(F.col("model_id") == m, F.struct("pred")))["pred"].alias(f"pred_{m}") for m in ids]
    )
    names = []
    if isinstance(preds.schema["pred"].dataType, T.ArrayType):
        cells = []
        for m in ids:
            value = col(f"pred_{m}")
            if classes == 2:
                cells.append(F.get(value, F.size(value) - 1).alias(f"pred_{m}"))
                names.append(f"pred_{m}")
            else:
                cells += [F.get(value, F.lit(k)).alias(f"pred_{m}_{k}") for k in range(classes)]
                names += [f"pred_{m}_{k}" for k in range(classes)]
        wide = wide.select(layout.id, layout.split, *cells)
    else:
        names = [f"pred_{m}" for m in ids]
    if scale:
        wide = Standardizer.fit(wide, names, scope="train", layout=layout).transform(wide)
    if features is not None:
        wide = wide.join(features.drop(layout.split, layout.label), layout.id, "left")
    if labels is not None:
        wide = wide.join(labels.select(layout.id, layout.label), layout.id, "left")
    return wide


def normalized(weights: Mapping[str, float]) -> dict[str, float]:
    """Weights divided by their sum."""
    total = sum(weights.values())
    if not total > 0:
        raise ValueError("weights must have a positive sum")
    return {m: w / total for m, w in weights.items()}


def weighted_blend(preds: DataFrame, weights: Mapping[str, float], layout: Layout = DEFAULT) -> DataFrame:
    """Weighted average of the models' predictions per id.

    The weights are a handful of constants, so the rows need no join. An id that
    lacks one of the models fails the job: its average would be another one.
    """
    share = normalized(weights)
    cases = " ".join(f"when model_id = {sql_text(m)} then {w!r}D" for m, w in share.items())
    weighted = preds.where(F.col("model_id").isin(list(share))).withColumn(
        "_w", F.expr(f"case {cases} end")
    )
    blend = F.when(
        F.count("pred") == len(share), F.sum(F.col("_w") * F.col("pred"))
    ).otherwise(F.raise_error(F.lit("a model has no prediction for some id")).cast("double"))
    return weighted.groupBy(layout.id).agg(blend.alias("pred"))


def weight_candidates(trials: DataFrame, model_ids: Sequence[str], seed: int = 42) -> DataFrame:
    """Normalised random weights per trial; a trial with all weights zero is left out."""
    raw = trials.select(
        "trial", *[hash_uniform(seed, F.col("trial"), F.lit(f"raw_w{i}")).alias(f"w{i}") for i in range(len(model_ids))]
    )
    names = [f"w{i}" for i in range(len(model_ids))]
    total = F.expr(" + ".join(names))
    return raw.where(total > 0).select("trial", *[(F.col(n) / total).alias(n) for n in names])


#: candidates that are held at once
BLOCK_CANDIDATES = 100_000
BLOCK_CELLS = 2_000_000


def search_weights(
    preds: DataFrame, labels: DataFrame, model_ids: Sequence[str], weights: DataFrame, top_k: int = 10,
    layout: Layout = DEFAULT, bins: int = 1024,
) -> DataFrame:
    """The ``top_k`` weightings by exact AUC of the blended predictions.

    First all candidates are scored coarsely in one pass: tasks reduce their rows to
    counts per candidate and score bin, which bound every AUC from both sides (pairs
    in one bin count as lost or as won). Only candidates whose upper bound reaches the
    top_k-th best lower bound are then scored exactly, so the answer is exact. Any number of
    candidates is worked off in blocks. A row without one of the predictions is an error.
    """
    ids = list(model_ids)
    names = [f"w{i}" for i in range(len(ids))]
    wide = (
        preds.where(F.col("model_id").isin(ids)).groupBy(layout.id)
        .agg(*[F.max(F.when(F.col("model_id") == m, F.col("pred"))).alias(f"p{i}") for i, m in enumerate(ids)])
        .join(labels.select(layout.id, layout.label), layout.id)
        .select(col(layout.label).cast("int").alias("y"), *[f"p{i}" for i in range(len(ids))])
        .where("y is not null")
    )
    # read three times: for its range, coarsely and exactly
    wide = settle(wide, "blend")
    spans = wide.agg(
        F.min(F.least(*[f"p{i}" for i in range(len(ids))]) if len(ids) > 1 else F.col("p0")),
        F.max(F.greatest(*[f"p{i}" for i in range(len(ids))]) if len(ids) > 1 else F.col("p0")),
        F.count_if(F.exists(F.array(*[F.col(f"p{i}") for i in range(len(ids))]), lambda p: p.isNull())),
    ).first()
    low, high = spans[0], spans[1]
    if spans[2]:
        raise ValueError(f"{spans[2]} rows lack a prediction of {ids}")
    found = []
    candidates = weights.select("trial", *names).toLocalIterator()
    while low is not None and (drawn := list(islice(candidates, BLOCK_CANDIDATES))):
        found += [tuple(r) for r in _search_block(wide, drawn, names, low, high, top_k, bins)]
    best = sorted(found, key=lambda r: (-r[1], r[0]))[:top_k]
    return preds.sparkSession.createDataFrame(best, "trial long, auc double").orderBy(F.desc("auc"), "trial")


def _search_block(wide, drawn, names, low, high, top_k, bins) -> list:
    """The ``top_k`` best of the drawn candidates."""
    matrix = [[r[n] for r in drawn] for n in names]
    columns = [f"p{i}" for i in range(len(names))]
    width = (high - low) or 1.0

    def partial(batches: Iterator, block: tuple[int, int]) -> Iterator:
        import numpy as np
        import pandas as pd

        w = np.array(matrix)[:, block[0]:block[1]]
        trials = w.shape[1]
        counts = np.zeros((2, trials, bins), dtype="int64")
        base = np.arange(trials) * bins
        for batch in batches:
            y = batch["y"].to_numpy()
            p = batch[columns].to_numpy(dtype="float64")
            for start in range(0, len(y), 4096):
                score = p[start:start + 4096] @ w
                at = np.clip(((score - low) / width * bins).astype("int64"), 0, bins - 1) + base
                for label in (0, 1):
                    hit = at[y[start:start + 4096] == label]
                    counts[label] += np.bincount(hit.ravel(), minlength=trials * bins).reshape(trials, bins)
        t, b = np.nonzero(counts.sum(axis=0))
        yield pd.DataFrame({"c": t + block[0], "bin": b, "pos": counts[1, t, b], "neg": counts[0, t, b]})

    bounds = []
    # the counts of one block of candidates fit in a task's memory
    size = max(1, BLOCK_CELLS // bins)
    for start in range(0, len(drawn), size):
        block = (start, min(start + size, len(drawn)))
        cells = wide.mapInPandas(
            lambda batches, block=block: partial(batches, block), "c int, bin int, pos long, neg long"
        )
        bounds += _auc_bounds(cells).collect()
    if not bounds:
        return []
    bar = sorted((r["low"] for r in bounds), reverse=True)[:top_k][-1]
    # float sums may differ in the last digits, hence the margin
    kept = [r["c"] for r in bounds if r["high"] >= bar - 1e-9]
    exact = None
    for start in range(0, len(kept), 200):
        part = _exact_scores(wide, matrix, drawn, kept[start:start + 200])
        exact = part if exact is None else exact.unionByName(part)
    return exact.orderBy(F.desc("auc"), "trial").limit(top_k).collect()


def _auc_bounds(cells: DataFrame) -> DataFrame:
    """Lowest and highest possible AUC per candidate from its counts per score bin."""
    cells = cells.groupBy("c", "bin").agg(
        F.sum("pos").cast("double").alias("pos"), F.sum("neg").cast("double").alias("neg")
    )
    lower = Window.partitionBy("c").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(lower), F.lit(0.0))
    pairs = F.sum("pos") * F.sum("neg")
    return (
        cells.withColumn("won", F.col("pos") * below)
        .groupBy("c")
        .agg(
            ratio(F.sum("won"), pairs).alias("low"),
            ratio(F.sum(F.col("won") + F.col("pos") * F.col("neg")), pairs).alias("high"),
        )
        .where("low is not null")
    )


def _exact_scores(wide: DataFrame, matrix, drawn, kept: Sequence[int]) -> DataFrame:
    blends = ", ".join(
        f"struct({drawn[c]['trial']}L as trial, "
        + " + ".join(f"{w[c]!r}D * p{i}" for i, w in enumerate(matrix))
        + " as score)"
        for c in kept
    )
    rows = wide.selectExpr("y", f"explode(array({blends})) as s").select("y", "s.trial", "s.score")
    return metrics.auc(rows, "score", "y", ["trial"])
