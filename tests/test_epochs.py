"""Perceptrons in steps: the kept step is the one early stopping picks, and a fit goes on where it ended."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowloom.operators import folds
from rowloom.plans import cv, epochs, models
from rowloom.session import fresh_path

MLP = models.LEARNERS["mlp"]
PARAMS = {"hidden_dims": [6], "epochs": 40}


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(5)
    n = 260
    x = rng.normal(0, 1, (n, 4))
    y = (x[:, 0] + 0.8 * rng.normal(0, 1, n) > 0).astype(int)
    rows = pd.DataFrame({"id": np.arange(n), "split": "train", "target": y, **{f"x{i}": x[:, i] for i in range(4)}})
    table = folds.stratified_folds(spark.createDataFrame(rows)).persist()
    p = models.prepare(table, MLP)
    train = p.data.where("split = 'train'")
    return table, cv.fold_stats(p, cv.DEFAULT)[0], train.where("fold <> 0").persist(), train.where("fold = 0").persist()


def test_kept_step_is_what_early_stopping_picks(parts):
    _, stats, train, valid = parts
    fit = epochs.fit_by_epochs(MLP, PARAMS, stats, train, valid, patience=2, step=4, least=0)
    curve = fit.curve.orderBy("epoch").toPandas()
    assert curve["epoch"].tolist() == list(range(4, 4 * len(curve) + 1, 4))
    losses = epochs.curve_losses(fit.curve, "logloss").withColumn("m", F.lit(1))
    picked = cv.early_stop_pick(losses, ["m"], "epoch", "loss", 2).first()
    assert (picked["best_iteration"], picked["best_loss"]) == (fit.best_epoch, fit.value)
    # overfitted by far at the end: it stopped early, and the kept model is that of the best step
    assert curve["epoch"].max() == min(fit.best_epoch + 8, 40)
    score = fit.model.transform(valid).select(MLP.score_column(fit.model).alias("p"), "target").toPandas()
    y, p = score["target"].to_numpy(), np.clip(score["p"].to_numpy(), 1e-15, 1 - 1e-15)
    assert -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) == pytest.approx(fit.value, abs=1e-12)


def test_least_epochs_are_run(parts):
    _, stats, train, valid = parts
    fit = epochs.fit_by_epochs(MLP, PARAMS, stats, train, valid, patience=1, step=5, least=30)
    assert fit.curve.agg(F.max("epoch")).first()[0] >= 30


def test_a_fit_goes_on_from_stored_steps(spark, parts):
    _, stats, train, valid = parts
    path = fresh_path(spark, "epochs")
    whole = epochs.fit_by_epochs(MLP, PARAMS, stats, train, valid, patience=9, step=5)
    epochs.fit_by_epochs(MLP, {**PARAMS, "epochs": 15}, stats, train, valid, patience=9, step=5, path=path)
    resumed = epochs.fit_by_epochs(MLP, PARAMS, stats, train, valid, patience=9, step=5, path=path)
    a, b = (x.curve.orderBy("epoch").toPandas() for x in (whole, resumed))
    assert a["epoch"].tolist() == b["epoch"].tolist() and np.allclose(a["value"], b["value"], atol=1e-9)
    assert resumed.best_epoch == whole.best_epoch
    assert np.allclose(resumed.model.weights.toArray(), whole.model.weights.toArray(), atol=1e-9)


def test_cross_validation_keeps_the_best_epochs(parts):
    table = parts[0]
    result = cv.cross_validate(table, "mlp", {"hidden_dims": [4], "epochs": 15}, patience=1, parallelism=2)
    curves: dict = {}
    for r in result.curves.collect():
        curves.setdefault(r["fold"], {})[r["iteration"]] = r["value"]
    for r in result.scores.collect():
        assert r["value"] == pytest.approx(curves[r["fold"]][r["best_iteration"]], abs=1e-12)
        assert r["value"] == min(curves[r["fold"]].values())
