"""Gradient descent of perceptrons against Spark's own solver."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from rowloom.plans import cv, descent, models, search
from rowloom.session import fresh_path
from rowloom.sources import stores

MLP = models.LEARNERS["mlp"]


def rows_of(spark, classes, n=431):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (n, 3))
    y = np.clip(np.floor(x[:, 0] + 0.7 * x[:, 1] ** 2 + 0.3 * rng.normal(0, 1, n)) + 1, 0, classes - 1)
    rows = pd.DataFrame({"target": y, "x": list(x)})
    return spark.createDataFrame(rows).repartition(3).select("target", array_to_vector("x").alias("features")).persist()


@pytest.mark.parametrize("classes,params", [
    (2, {"hidden_dims": [7, 5], "epochs": 12, "block_size": 32, "lr": 0.4}),
    (3, {"hidden_dims": [6], "epochs": 9, "block_size": 50, "lr": 1.5}),
    (2, {"hidden_dims": [4], "epochs": 5, "block_size": 100_000, "lr": 0.03}),
])
def test_weights_are_those_of_sparks_solver(spark, monkeypatch, classes, params):
    """Short last blocks, several chunks and pieces, two classes and three."""
    monkeypatch.setattr(descent, "CHUNK_ROWS", 64)
    monkeypatch.setattr(descent, "PIECE", 10)
    rows = rows_of(spark, classes)
    estimator = MLP.estimator(params, cv.TrainStats(431, 0.0, 3, classes), 42).setLabelCol("target")
    assert estimator.getSolver() == "gd"
    wanted, got = estimator.fit(rows), descent.fit(estimator, rows)
    start = estimator.copy({estimator.maxIter: 0}).fit(rows).weights.toArray()
    moved = np.linalg.norm(wanted.weights.toArray() - start)
    assert moved > 0 and np.linalg.norm(got.weights.toArray() - wanted.weights.toArray()) < 1e-5 * moved
    assert list(got.getLayers()) == list(wanted.getLayers())
    a, b = (np.array(got.transform(rows).select(c).toPandas().iloc[:, 0].tolist()) for c in ("probability", descent.probabilities(got).alias("p")))
    assert np.allclose(a, b, rtol=0, atol=1e-12)


def test_it_stops_where_sparks_solver_does(spark):
    rows = rows_of(spark, 2)
    estimator = MLP.estimator({"hidden_dims": [4], "epochs": 40, "block_size": 64, "lr": 0.05}, cv.TrainStats(431, 0.0, 3, 2), 42)
    estimator = estimator.setLabelCol("target").setTol(1e-2)
    wanted, got = estimator.fit(rows).weights.toArray(), descent.fit(estimator, rows).weights.toArray()
    longer = estimator.copy({estimator.tol: 0.0}).fit(rows).weights.toArray()
    assert np.allclose(got, wanted, atol=1e-5) and not np.allclose(longer, wanted, atol=1e-3)


@pytest.mark.parametrize("label", [None, 2.0, 0.5, float("nan")])
def test_labels_that_are_no_class_are_an_error(spark, label):
    rows = rows_of(spark, 2).select(F.lit(label).cast("double").alias("target"), "features")
    estimator = MLP.estimator({"hidden_dims": [4], "epochs": 2, "lr": 0.1}, cv.TrainStats(431, 0.0, 3, 2), 42).setLabelCol("target")
    for fit in (estimator.fit, lambda rows: descent.fit(estimator, rows)):
        with pytest.raises(Exception):
            fit(rows)


def test_a_search_computes_its_table_once(spark):
    """Two trials and their folds' facts read rows that were computed once."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(200).selectExpr(
        "id", "'train' as split", "cast(id % 5 as int) as fold", "cast(id % 2 as int) as target", "cast(id * 7 % 31 as double) as a",
    )
    df = df.mapInArrow(counted, df.schema)
    store = stores.TrialStore(spark, fresh_path(spark, "trials"))
    space = (search.Dim("lr", low=0.01, high=0.1),)
    out = search.search_model(df, "mlp", 2, store, space=space, fixed={"epochs": 2, "hidden_dims": [3]})
    assert [r["state"] for r in out.collect()] == ["complete"] * 2
    assert read.value == 200
