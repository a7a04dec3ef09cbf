"""Perceptrons fitted in steps of some epochs, scored on left-out rows, kept at their best step.

A step continues from the weights of the one before (the optimiser's memory starts anew). With a folder,
weights and score of every step are stored as soon as it ends, and a fit that was cut short goes on from there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions import metrics
from rowloom.layout import DEFAULT, Layout
from rowloom.plans.models import Learner, TrainStats

#: epochs of a step, and epochs that are run before stopping may end a fit
STEP, LEAST_EPOCHS = 5, 10


@dataclass
class EpochFit:
    model: MultilayerPerceptronClassificationModel
    best_epoch: int
    value: float | None
    curve: DataFrame  # epoch, value


def _stored(spark, path: str | None) -> list[tuple[int, float | None, list[float]]]:
    """Steps of an earlier run, in order: epoch, value, weights."""
    if path is None:
        return []
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return []
    rows = spark.read.schema("epoch int, value double, weights array<double>").parquet(path).dropDuplicates(["epoch"]).collect()
    return sorted((r["epoch"], r["value"], r["weights"]) for r in rows)


def fit_by_epochs(
    learner: Learner, params: dict | None, stats: TrainStats, train: DataFrame, valid: DataFrame, layout: Layout = DEFAULT,
    seed: int = 42, patience: int = 2, step: int = STEP, least: int = LEAST_EPOCHS, path: str | None = None,
) -> EpochFit:
    """Fit up to ``epochs`` of the parameters; stop once ``patience`` steps in a row after ``least`` epochs bring no gain.

    Kept is the step with the best score on ``valid`` by the learner's metric, the first of equal ones. What is
    held on the driver is a perceptron's weights, one set a step that was the best so far.
    """
    from rowloom.plans.cv import scores_by

    spark, params = train.sparkSession, learner.resolve(params)
    sign = -1 if metrics.HIGHER_IS_BETTER[learner.metric] else 1
    epochs, done = int(params["epochs"]), _stored(spark, path)
    curve = [(e, v) for e, v, _ in done]
    weights = done[-1][2] if done else None
    estimator = learner.estimator({**params, "epochs": step}, stats, seed).setLabelCol(layout.label).setTol(0.0)

    def better(a: float | None, b: float | None) -> bool:
        return a is not None and (b is None or sign * a < sign * b)

    best: tuple[int, float | None, list[float]] | None = None
    for e, v, w in done:
        if best is None or better(v, best[1]):
            best = (e, v, w)
    model = None
    while True:
        at = curve[-1][0] if curve else 0
        idle = sum(1 for e, _ in curve if best and e > max(best[0], least - step))
        if at >= epochs or idle >= patience and at >= least:
            break
        if weights is not None:
            estimator = estimator.setInitialWeights(Vectors.dense(weights))
        model = estimator.setMaxIter(min(step, epochs - at)).fit(train)
        weights = model.weights.toArray().tolist()
        scored = model.transform(valid).select(layout.label, learner.score_column(model, stats.classes).alias("pred"))
        row = scores_by(scored, learner, stats.classes, layout.label).first()
        value = row["value"] if row else None
        at += min(step, epochs - at)
        curve.append((at, value))
        if best is None or better(value, best[1]):
            best = (at, value, weights)
        if path is not None:
            spark.createDataFrame([(at, value, weights)], "epoch int, value double, weights array<double>").write.mode("append").parquet(path)
    # one iteration from given weights would move them; none are run, so the model is the stored one
    kept = estimator.setInitialWeights(Vectors.dense(best[2])).setMaxIter(0).fit(train.limit(1))
    return EpochFit(kept, best[0], best[1], spark.createDataFrame(curve, "epoch int, value double"))


def curve_losses(curve: DataFrame, metric: str) -> DataFrame:
    """The curve as losses, for ``early_stop_pick``."""
    sign = -1 if metrics.HIGHER_IS_BETTER[metric] else 1
    return curve.select("epoch", (sign * F.col("value")).alias("loss"))
