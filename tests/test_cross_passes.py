"""Crosses of large pairs: rows move whole, once for each anchor, and are not joined back by their id."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowloom.operators import categories as cat
from rowloom.operators import crosses
from rowloom.operators.crosses import CrossMeans
from rowloom.operators.folds import stratified_folds
from rowloom.plans import recipes
from rowloom.session import release, settle
from tests.test_crosses import COLS, expected

SCHEMA = "id long, split string, fold int, target int, a string, b string, x double, n int"


@pytest.fixture(scope="module")
def rows():
    """Columns with frequent and with rare levels, missing ones, and levels that only test rows have."""
    rng = random.Random(7)
    out = []
    for i in range(900):
        train = i % 4 > 0
        a = rng.choice(["p", "q", None, *([f"r{rng.randint(0, 60)}"] * 2)]) if train else rng.choice(["p", None, "new", f"r{rng.randint(0, 60)}"])
        x = rng.choice([0.5, None, float(rng.randint(0, 80)), float(rng.randint(0, 80))])
        out.append((i, "train" if train else "test", i % 5 if train else None, rng.randint(0, 1) if train else None, a, rng.choice(["u", "w", f"v{rng.randint(0, 30)}"]), x, rng.choice([0, 0, rng.randint(1, 90)])))
    return out


def close(found, want):
    assert found.keys() == want.keys()
    for i, values in want.items():
        assert found[i] == [None if v is None else pytest.approx(v, abs=1e-12) for v in values]


@pytest.mark.parametrize("hot_rows,hot_bytes,held_bytes", [(100_000, 1 << 20, 0), (25, 1 << 20, 0), (25, 0, 0), (25, 0, 60_000), (1, 0, 0)])
def test_crosses_of_frequent_and_rare_codes(spark, rows, monkeypatch, hot_rows, hot_bytes, held_bytes):
    for name, value in {"HOT_ROWS": hot_rows, "HOT_BYTES": hot_bytes, "HELD_BYTES": held_bytes, "CHUNK_ROWS": 50, "BATCH_PAIRS": 1}.items():
        monkeypatch.setattr(crosses, name, value)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3, "n")
    fit = CrossMeans.fit(df, COLS)
    assert any(fit.hot) == (hot_rows < 900)
    wide = [p for p in range(6) if p not in fit.whole]
    if hot_rows == 25:
        # crosses of a frequent code are dealt by the other column unless all of them are held
        assert any(frequent for anchor in fit._anchors(wide) for *_, frequent in anchor.jobs) == (hot_bytes == 0)
    want = expected(rows)
    close({r[0]: list(r)[1:] for r in fit.transform().collect()}, want)
    close({r[0]: list(r)[1:] for r in fit.transform(bytes_=0).collect()}, want)


def test_rows_of_a_repeated_or_missing_id_have_their_own_means(spark, rows):
    same = [(7 if r[0] % 3 else None, *r[1:]) for r in rows]
    df = spark.createDataFrame(same, SCHEMA)
    want = expected(rows)
    got = CrossMeans.fit(df.withColumn("at", F.col("n").cast("long")), COLS, keep=["fold", "a"]).transform(bytes_=0)
    assert got.columns[:3] == ["id", "fold", "a"]
    digits = lambda values: tuple(None if v is None else round(v, 9) for v in values)
    found = Counter((r[0], r[1], r[2], digits(r[3:])) for r in got.collect())
    assert found == Counter((r[0], r[2], r[4], digits(want[i])) for i, r in enumerate(same))


def test_large_pairs_are_not_exploded(spark, rows, monkeypatch):
    """No row per pair, no join back: whole rows are dealt once for each anchor."""
    monkeypatch.setattr(crosses, "HELD_BYTES", 0)
    fit = CrossMeans.fit(spark.createDataFrame(rows, SCHEMA), COLS)
    assert fit.table is None
    plan = fit.transform()._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join " not in plan
    assert 1 <= plan.count("RepartitionByExpression") < len(COLS)


def test_cross_recipe_joins_repeated_ids_only(spark, rows):
    """With ids of one row nothing is joined; a repeated id joins its rows, a missing one has none, as by a plain join."""
    names = [f"{n}_te" for *_, n in cat.cross_columns(COLS)]

    def old(df):
        df = stratified_folds(df)
        encoded = cat.TargetEncoder.fit(df, ["a", "b"]).transform(df)
        return encoded.join(CrossMeans.fit(df, COLS).transform(), "id").select("id", "split", "fold", "target", "x", "n", "a_te", "b_te", *names)

    def found(df):
        return Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())

    df = spark.createDataFrame([(r[0], r[1], *r[3:]) for r in rows], "id long, split string, target int, a string, b string, x double, n int")
    new = recipes.features(df, 8)
    assert "Join " not in new._jdf.queryExecution().optimizedPlan().toString()
    assert set(new.columns) == set(old(df).columns)
    assert found(new.select(*old(df).columns)) == found(old(df))
    odd = settle(df.withColumn("id", F.when(F.col("id") < 40, F.col("id") % 7).when(F.col("id") != 50, F.col("id"))), "odd")
    assert found(recipes.features(odd, 8).select(*old(odd).columns)) == found(old(odd))


def test_shuffle_files_go_with_the_write(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = blocks.getAllFiles()
        return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}

    before = files()
    dealt = spark.range(1000).repartition(3, "id")
    out = settle(dealt, "dealt", passing=True)
    assert not files() - before
    assert out.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    path = out._settled
    assert os.path.isdir(path)
    release(out)
    assert not os.path.exists(path)
