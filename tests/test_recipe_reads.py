"""Preprocessing and recipes compute the tables they are given once, however many passes their encoders need."""

import numpy as np
import pandas as pd
import pytest

from rowloom.operators import folds
from rowloom.operators.crosses import CrossMeans
from rowloom.plans import recipes

ROWS = 400


@pytest.fixture
def raw(spark):
    rng = np.random.default_rng(3)
    return spark.createDataFrame(pd.DataFrame({
        "id": np.arange(ROWS), "balance": rng.normal(100, 30, ROWS), "campaign": rng.integers(1, 9, ROWS).astype(float),
        "duration": rng.gamma(2, 50, ROWS), "previous": rng.integers(0, 3, ROWS), "pdays": rng.integers(-1, 4, ROWS),
        "job": rng.choice(["a", "b", "c"], ROWS), "y": rng.integers(0, 2, ROWS),
    }))


def counted(spark, df):
    """``df`` and a counter of the rows of it that were computed."""
    read = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return df.mapInArrow(through, df.schema), read


def test_preprocessing_computes_its_rows_once(spark, raw):
    train, read = counted(spark, raw.where("id % 4 > 0"))
    out = recipes.preprocess(train, raw.where("id % 4 = 0").drop("y"), 4)
    assert out.count() == ROWS
    assert read.value == ROWS * 3 // 4


@pytest.mark.parametrize("recipe", [2, 4, 6, 7])
def test_recipes_compute_their_table_once(spark, raw, recipe):
    tagged = raw.withColumnRenamed("y", "target").selectExpr("*", "case when id % 4 > 0 then 'train' else 'test' end as split")
    df, read = counted(spark, tagged)
    out = recipes.features(df, recipe)
    out.write.format("noop").mode("overwrite").save()
    assert read.value == ROWS


def test_looked_up_crosses_move_found_means_only(spark, raw):
    """The means go to their rows one by one, not as one column per pair before the shuffle."""
    tagged = raw.withColumnRenamed("y", "target").selectExpr("*", "case when id % 4 > 0 then 'train' else 'test' end as split")
    cols = ["balance", "campaign", "job"]
    fit = CrossMeans.fit(folds.stratified_folds(tagged), cols)
    out = fit.transform(bytes_=0)
    assert "REPARTITION_BY_COL" in out._jdf.queryExecution().executedPlan().toString()
    wide = {r["id"]: r for r in out.collect()}
    held = {r["id"]: r for r in fit.transform().collect()}
    assert set(wide) == set(held)
    for i, r in held.items():
        for x, y in zip(r, wide[i]):
            assert x is None and y is None or x == pytest.approx(y, rel=1e-12)
