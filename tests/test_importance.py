"""Permutation importance against a version that multiplies rows and applies the whole model to each."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from rowloom.layout import DEFAULT
from rowloom.operators import folds
from rowloom.operators.ordering import shuffled_rank
from rowloom.plans import cv, importance, models


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 600
    x = rng.normal(0, 1, (n, 3))
    frame = pd.DataFrame({
        "id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "flat": 1.0, "c": x[:, 2], "split": "train",
        "target": (x[:, 0] - 0.5 * x[:, 1] + rng.normal(0, 0.5, n) > 0).astype(int),
    })
    frame["y"] = 2 * x[:, 0] + x[:, 2]
    return folds.stratified_folds(spark.createDataFrame(frame)).persist()


def multiplied(model, prepared, learner, rows, classes=2, seed=42):
    """{feature or None: score}, a row per feature and row."""
    here = shuffled_rank(rows, "id", seed, out="_rank").withColumn("own", vector_to_array("features"))
    there = shuffled_rank(rows.select("id", "features"), "id", seed + 1, out="_rank")
    both = here.join(there.select("_rank", vector_to_array("features").alias("other")), "_rank")
    out = {}
    for i, name in [(-1, None), *enumerate(prepared.names)]:
        vector = F.transform("own", lambda x, k: F.when(k == i, F.get("other", k)).otherwise(x))
        said = model.transform(both.select("target", array_to_vector(vector).alias("features")))
        said = said.select("target", learner.score_column(model, classes).alias("pred"))
        out[name] = cv.scores_by(said, learner, classes, "target").first()["value"]
    return out


@pytest.mark.parametrize("name,params,block", [
    ("gbt", {"rounds": 6, "max_depth": 2}, 64),
    ("gbt", {"rounds": 6, "max_depth": 2}, 4),
    ("rf_clf", {"n_estimators": 5, "max_depth": 3}, 3),
    ("rf_reg", {"n_estimators": 5, "max_depth": 3}, 64),
    ("logreg", {}, 2),
])
def test_equal_to_multiplied_rows(table, name, params, block):
    learner = models.LEARNERS[name]
    df = table.drop("y") if learner.classifier else table.withColumn("target", F.col("y")).drop("y")
    p = models.prepare(df, learner)
    fit = learner.estimator(params, cv.fold_stats(p, DEFAULT)[None], 7).setLabelCol("target").fit(p.data)
    want = multiplied(fit, p, learner, p.data)
    got = {r.feature: r for r in importance.permutation_importance(fit, p, learner, p.data, block=block).collect()}
    sign = 1 if learner.metric == "auc" else -1
    assert list(got) == p.names
    for feature in p.names:
        assert got[feature].drop == pytest.approx((want[None] - want[feature]) * sign, abs=1e-9)
    assert max(got.values(), key=lambda r: r.drop).feature == "a"
    assert got["flat"].drop == 0
    if learner.trees:
        assert not got["flat"].used


def test_unused_features_are_not_scored(table, monkeypatch):
    learner = models.LEARNERS["gbt"]
    p = models.prepare(table.drop("y"), learner)
    fit = learner.estimator({"rounds": 1, "max_depth": 1}, cv.fold_stats(p, DEFAULT)[None], 7).setLabelCol("target").fit(p.data)
    asked = []
    real = importance._block_scores
    monkeypatch.setattr(importance, "_block_scores", lambda s, names, *r: asked.extend(names) or real(s, names, *r))
    out = {r.feature: r for r in importance.permutation_importance(fit, p, learner, p.data).collect()}
    assert asked == [-1, p.names.index("a")]
    assert {f: (r.drop, r.used) for f, r in out.items() if f != "a"} == {f: (0.0, False) for f in ("b", "flat", "c")}
    assert out["a"].drop > 0.1


def test_no_rows_and_a_model_without_splits(spark, table):
    learner = models.LEARNERS["gbt"]
    p = models.prepare(table.drop("y"), learner)
    stats = cv.fold_stats(p, DEFAULT)[None]
    fit = learner.estimator({"rounds": 2, "max_depth": 1}, stats, 7).setLabelCol("target").fit(p.data)
    none = importance.permutation_importance(fit, p, learner, p.data.where("id < 0")).collect()
    assert all(r.drop is None if r.used else r.drop == 0 for r in none)
    bare = learner.estimator({"rounds": 1, "max_depth": 0}, stats, 7).setLabelCol("target").fit(p.data)
    assert [tuple(r) for r in importance.permutation_importance(bare, p, learner, p.data).collect()] == [(n, 0.0, False) for n in p.names]
