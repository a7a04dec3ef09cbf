"""Boosted models round by round, against models that are cut and scored one after another."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowloom.operators import folds
from rowloom.plans import cv, models, staged

GBT = models.LEARNERS["gbt"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 1200
    x = rng.normal(0, 1, (n, 3))
    p = 1 / (1 + np.exp(-1.2 * x[:, 0] + x[:, 1] * x[:, 2]))
    rows = pd.DataFrame({
        "id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "kind": np.where(x[:, 2] > 0.3, "up", "down"),
        "split": np.where(np.arange(n) % 6 == 0, "test", "train"), "target": (rng.random(n) < p).astype(int),
    })
    return folds.stratified_folds(spark.createDataFrame(rows)).persist()


@pytest.fixture(scope="module")
def fitted(table):
    p = models.prepare(table, GBT)
    stats = cv.fold_stats(p, cv.DEFAULT)
    train = p.data.where("split = 'train'")
    params = {"rounds": 9, "max_depth": 4}
    return {f: cv._fit(GBT, params, stats[f], train.where(F.col("fold") != f), cv.DEFAULT, 5) for f in (0, 1)}, train


def auc(score, label):
    rank = pd.Series(score).rank().to_numpy()
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def cut_scores(model, valid):
    """AUC after each round by a loop over cut models."""
    out = []
    for k in range(1, model.getNumTrees + 1):
        got = staged.truncated(model, k).transform(valid).select(GBT.score_column(model).alias("p"), "target").toPandas()
        out.append(auc(got["p"].to_numpy(), got["target"].to_numpy()))
    return out


def test_a_cut_model_is_the_model_of_fewer_rounds(fitted, table):
    fits, train = fitted
    whole = staged.truncated(fits[0], 9).transform(train).select("id", "probability").orderBy("id").collect()
    assert whole == fits[0].transform(train).select("id", "probability").orderBy("id").collect()
    stats = cv.fold_stats(models.prepare(table, GBT), cv.DEFAULT)[0]
    short = cv._fit(GBT, {"rounds": 4, "max_depth": 4}, stats, train.where("fold <> 0"), cv.DEFAULT, 5)
    cut = staged.truncated(fits[0], 4)
    assert cut.getNumTrees == 4 and cut.treeWeights == short.treeWeights
    assert cut.transform(train).select("id", "probability").orderBy("id").collect() == short.transform(train).select("id", "probability").orderBy("id").collect()
    assert len(cut.featureImportances) == 4
    with pytest.raises(ValueError):
        staged.truncated(fits[0], 10)


@pytest.mark.parametrize("first,last", [(1, 9), (4, 7)])
def test_margins(fitted, first, last):
    fits, train = fitted
    rows = staged.with_margins(fits[0], train, first, last).limit(50).collect()
    for k in range(first, last + 1):
        raw = {r["id"]: r["rawPrediction"][1] for r in staged.truncated(fits[0], k).transform(train).collect()}
        assert all(r["margins"][k - first] == pytest.approx(raw[r["id"]], abs=1e-12) for r in rows)


def test_curves_and_kept_rounds_equal_a_loop_over_cut_models(fitted):
    fits, train = fitted
    want = {f: cut_scores(m, train.where(F.col("fold") == f)) for f, m in fits.items()}
    got = {(r["fold"], r["iteration"]): r["value"] for r in staged.round_scores(fits, train, "auc").collect()}
    assert len(got) == 18
    assert all(got[f, k + 1] == pytest.approx(v, abs=1e-12) for f, c in want.items() for k, v in enumerate(c))
    for block in (64, 2):
        best, curves = staged.best_rounds(fits, train, "auc", 2, block=block)
        assert best == {f: cv.first_best([-round(v, 12) for v in c], 2) + 1 for f, c in want.items()}
        picked = cv.early_stop_pick(curves.withColumn("loss", -F.col("value")), ["fold"], "iteration", "loss", 2).collect()
        assert {r["fold"]: r["best_iteration"] for r in picked} == best


def test_loss_curve(fitted):
    fits, train = fitted
    row = staged.round_scores({0: fits[0]}, train, "logloss", first=3, last=3).first()
    got = staged.truncated(fits[0], 3).transform(train.where("fold = 0")).select(GBT.score_column(fits[0]).alias("p"), "target").toPandas()
    y, p = got["target"].to_numpy(), got["p"].to_numpy()
    assert row["value"] == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)), abs=1e-12)


def test_cross_validation_stops_by_auc(table):
    result = cv.cross_validate(table, "gbt", {"rounds": 8, "max_depth": 5}, patience=2, seed=5)
    curves = {}
    for r in result.curves.collect():
        curves.setdefault(r["fold"], {})[r["iteration"]] = r["value"]
    for r in result.scores.collect():
        assert result.models[r["fold"]].getNumTrees == r["best_iteration"]
        assert r["value"] == pytest.approx(curves[r["fold"]][r["best_iteration"]], abs=1e-12)
        assert r["value"] == max(v for k, v in curves[r["fold"]].items() if k <= r["best_iteration"] + 2)
    _, value, best = cv.fit_one_fold(table, "gbt", {"rounds": 8, "max_depth": 5}, 0, patience=2, seed=5)
    same = result.scores.where("fold = 0").first()
    assert (value, best) == (pytest.approx(same["value"], abs=1e-12), same["best_iteration"])
