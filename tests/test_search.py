"""Grids by number, studies that close their gaps, ranks with ties."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest

from rowloom.operators import ordering
from rowloom.plans import search
from rowloom.session import fresh_path
from rowloom.sources.stores import TrialStore

SPACE = (
    search.Dim("rate", low=0.1, high=0.7), search.Dim("penalty", low=1e-3, high=10.0, log=True), search.Dim("depth", "int", 3, 5),
    search.Dim("kind", "choice", choices=("a", "b")), search.Dim("double_depth", sql="2 * depth"),
)


def test_grid_is_the_product(spark):
    size = search.grid_size(SPACE, 3)
    assert size == 3 * 3 * 3 * 2
    rows = search.grid_candidates(spark.range(-2, size + 5).withColumnRenamed("id", "trial"), SPACE, 3).orderBy("trial").collect()
    want = list(itertools.product([0.1, 0.4, 0.7], [1e-3, 0.1, 10.0], [3, 4, 5], ["a", "b"]))
    assert [r["trial"] for r in rows] == list(range(size))
    for r, (rate, penalty, depth, kind) in zip(rows, want):
        assert (r["rate"], r["penalty"]) == (pytest.approx(rate), pytest.approx(penalty))
        assert (r["depth"], r["kind"], r["double_depth"]) == (depth, kind, 2 * depth)
    block = search.grid_candidates(spark.range(20, 23).withColumnRenamed("id", "trial"), SPACE, 3).orderBy("trial").collect()
    assert block == rows[20:23]


def test_a_grid_search_goes_on_in_the_middle_and_ends(spark):
    store = TrialStore(spark, fresh_path(spark, "t"))
    space = SPACE[2:4]
    for n in (4, 4):
        out = search.run_search(lambda p: p["depth"] + (p["kind"] == "b"), space, n, store, "g", grid=3)
    got = {r["trial"]: (r["params"]["depth"], r["params"]["kind"], r["value"]) for r in out.collect()}
    assert got == {i: (str(d), k, d + float(k == "b")) for i, (d, k) in enumerate(itertools.product([3, 4, 5], "ab"))}


class Ending(TrialStore):
    """Loses some trials, as a run does that ends while they are fitted."""

    def append(self, study, trials):
        if trials.first()["trial"] in (1, 4):
            raise OSError("lost")
        super().append(study, trials)


@pytest.mark.parametrize("parallelism", [1, 3])
def test_lost_trials_are_done_again(spark, parallelism):
    path = fresh_path(spark, "t")
    whole = search.run_search(lambda p: p["rate"], SPACE[:1], 6, TrialStore(spark, fresh_path(spark, "t")), "s").collect()
    with pytest.raises(OSError):
        search.run_search(lambda p: p["rate"], SPACE[:1], 6, Ending(spark, path), "s", parallelism=parallelism)
    store = TrialStore(spark, path)
    done = {r["trial"] for r in store.load("s").collect()}
    assert not done & {1, 4} and len(done) < 6
    again = []
    out = search.run_search(lambda p: again.append(p["rate"]) or p["rate"], SPACE[:1], 0, store, "s", parallelism=parallelism).collect()
    assert {(r["trial"], r["value"]) for r in out} == {(r["trial"], r["value"]) for r in whole}
    assert sorted(again) == sorted(r["value"] for r in whole if r["trial"] not in done)


def test_appends_count_once_and_files_become_one(spark):
    store = TrialStore(spark, fresh_path(spark, "t"))
    rows = [(i, {"a": str(i)}, float(i), "complete") for i in range(5)]
    for r in [*rows, (2, {"error": "x"}, None, "fail"), rows[3]]:
        store.append("s", spark.createDataFrame([r], "trial long, params map<string,string>, value double, state string"))
    before = sorted(map(tuple, store.load("s").select("trial", "value", "state").collect()))
    assert before == [(i, float(i), "complete") for i in range(5)]
    store.compact("s")
    assert sorted(map(tuple, store.load("s").select("trial", "value", "state").collect())) == before
    assert len(spark.read.parquet(store._path("s")).inputFiles()) == 1
    store.compact("unknown")


@pytest.mark.parametrize("buckets", [None, 5])
def test_average_ranks(spark, buckets):
    rng = random.Random(1)
    x = [rng.choice([rng.random(), 1.0, -0.0, 0.0, 2.0, float("inf"), None]) for _ in range(300)]
    got = {r["value"]: r["rank"] for r in ordering.average_ranks(spark.createDataFrame([(v,) for v in x], "x double"), "x", buckets).collect()}
    kept = pd.Series([v for v in x if v is not None])
    assert got == dict(zip(kept + 0.0, kept.rank()))


def test_rank_correlation(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 9, 400).astype(float)
    b = a + rng.integers(0, 12, 400)
    df = pd.DataFrame({"a": a, "b": b})
    df.loc[::17, "b"] = np.nan
    got = search.rank_correlation(spark.createDataFrame(df), "a", "b")
    kept = df.dropna()
    assert got == pytest.approx(np.corrcoef(kept["a"].rank(), kept["b"].rank())[0, 1], abs=1e-12)
    assert search.rank_correlation(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), "a", "b") is None
