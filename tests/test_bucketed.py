"""Tables bucketed by id: results, refusals, and plans that move no rows."""

import pytest
from pyspark.sql import functions as F

from rowloom.sources.bucketed import BucketedStore, meta_features, save_predictions


@pytest.fixture()
def store(spark, tmp_path):
    return BucketedStore(spark, str(tmp_path), buckets=4)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def numbers(spark, n, name):
    return spark.range(n).select(F.concat(F.lit("r"), F.col("id")).alias("id"), (F.col("id") * 2).alias(name))


def test_blocks_join_without_an_exchange(spark, store):
    for name in ("a", "b", "c"):
        store.save(numbers(spark, 500, f"{name} x"), name)
    wide = store.side_by_side("a", "b", "c")
    assert "Exchange" not in plan(wide)
    rows = wide.collect()
    assert len(rows) == 500 and wide.columns == ["id", "a x", "b x", "c x"]
    assert all(r["a x"] == r["b x"] == r["c x"] == 2 * int(r["id"][1:]) for r in rows)
    # rows by id can be grouped without an exchange as well
    assert "Exchange" not in plan(wide.groupBy("id").count())


def test_another_session_knows_the_buckets(spark, store):
    store.save(numbers(spark, 50, "x"), "a")
    store.save(numbers(spark, 50, "y"), "b")
    other = spark.newSession()
    for table in other.catalog.listTables():
        if table.name.startswith("rowloom_"):
            other.sql(f"drop table {table.name}")  # external: the files stay
    again = BucketedStore(other, store.root, buckets=4).side_by_side("a", "b")
    assert "Exchange" not in plan(again) and again.count() == 50


def test_ids_that_differ_repeat_or_are_missing(spark, store):
    store.save(numbers(spark, 50, "x"), "a")
    store.save(numbers(spark, 51, "y"), "more")
    store.save(numbers(spark, 51, "y").where("id <> 'r7'"), "others")
    for name in ("more", "others"):
        with pytest.raises(ValueError, match="same ids"):
            store.side_by_side("a", name)
    with pytest.raises(ValueError, match="must not repeat"):
        store.save(numbers(spark, 5, "z").unionAll(numbers(spark, 1, "z")), "twice")
    with pytest.raises(ValueError, match="must be there"):
        store.save(numbers(spark, 5, "z").withColumn("id", F.nullif("id", F.lit("r3"))), "null")
    assert store.find("twice") is None and store.find("null") is None
    with pytest.raises(ValueError, match="share columns"):
        store.side_by_side("more", "more2") if store.save(numbers(spark, 51, "Y"), "more2") else None
    other = BucketedStore(spark, store.root, buckets=2)
    other.save(numbers(spark, 50, "w"), "coarse")
    with pytest.raises(ValueError, match="other buckets"):
        store.side_by_side("a", "coarse")


def test_a_save_replaces_the_last_version_only_when_whole(spark, store):
    store.save(numbers(spark, 5, "x"), "a")
    with pytest.raises(ValueError):
        store.save(numbers(spark, 1, "x").unionAll(numbers(spark, 1, "x")), "a")
    assert store.read("a").count() == 5
    assert store.save(numbers(spark, 6, "x"), "a").version == 2
    assert store.read("a").count() == 6


def test_empty_tables(spark, store):
    store.save(numbers(spark, 0, "x"), "a")
    store.save(numbers(spark, 0, "y"), "b")
    assert store.side_by_side("a", "b").collect() == []


def test_meta_features(spark, store):
    rows = spark.range(40).select("id", F.when(F.col("id") < 30, "train").otherwise("test").alias("split"))
    preds = rows.crossJoin(spark.createDataFrame([("m1", 1.0), ("m2", 2.0)], "model_id string, w double"))
    preds = preds.withColumn("pred", F.col("id") * F.col("w"))
    store.save(rows, "features")
    store.save(rows.where("split = 'train'").select("id", F.lit(1).alias("target")), "labels")
    save_predictions(store, preds, ["m2", "m1"])
    out = meta_features(store, ["m2", "m1"], "features", "labels")
    assert "Exchange" not in plan(out) and out.columns == ["id", "split", "pred_m2", "pred_m1", "target"]
    for r in out.collect():
        assert (r.pred_m2, r.pred_m1) == (2.0 * r.id, 1.0 * r.id) and r.target == (1 if r.id < 30 else None)
    # a model that lacks a row is not padded
    save_predictions(store, preds.where("id <> 3"), ["m1"])
    with pytest.raises(ValueError, match="same ids"):
        meta_features(store, ["m2", "m1"], "features")
