"""Operators against plain pandas or numpy on small tables, edge cases included."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rowloom.functions import metrics
from rowloom.functions.scalars import yeo_johnson
from rowloom.operators import categories as cat
from rowloom.operators import columns, folds, joins, ordering, profile, quantiles, sets
from rowloom.operators import numeric as num


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    n = 3000
    # one level holds over a third of all rows
    level = rng.choice(["hot", *[f"c{i}" for i in range(60)]], n, p=[0.4, *[0.01] * 60])
    df = pd.DataFrame(
        {
            "id": np.arange(n), "level": level, "x": rng.normal(0, 50, n).round(1),
            "count": rng.poisson(2, n), "split": np.where(np.arange(n) % 4 == 0, "test", "train"),
            "target": (rng.random(n) < 0.3).astype(int),
        }
    )
    df.loc[df.index % 23 == 0, "level"] = None
    df.loc[(df["split"] == "test") & (df.index % 40 == 0), "level"] = "only_test"
    df.loc[1, "level"] = "once"
    return df


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows.astype(object).where(rows.notna(), None), (
        "id long, level string, x double, count long, split string, target long"
    ))


def by_id(df):
    return df.toPandas().sort_values("id").reset_index(drop=True)


# ---------------------------------------------------------------------- folds


def test_folds_are_even_and_seeded(table):
    got = by_id(folds.stratified_folds(table, 5))
    train = got[got["split"] == "train"]
    assert got.loc[got["split"] == "test", "fold"].isna().all()
    sizes = train.groupby(["target", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all() and sizes.shape == (2, 5)
    again = by_id(folds.stratified_folds(table.repartition(7), 5))
    assert got["fold"].equals(again["fold"])
    other = by_id(folds.stratified_folds(table, 5, seed=1))
    assert not got["fold"].equals(other["fold"])


@pytest.mark.parametrize("prefix", [1, 2, 4])
def test_fold_does_not_depend_on_bucket_count(table, prefix):
    assert by_id(folds.plain_folds(table, 3, prefix=prefix))["fold"].equals(
        by_id(folds.plain_folds(table, 3))["fold"]
    )


def test_running_extreme(spark):
    rng = np.random.default_rng(3)
    values = [(1, i, None if i % 7 == 0 else float(rng.normal())) for i in range(500)]
    df = spark.createDataFrame(values, "g int, t int, v double")
    got = ordering.running_extreme(df, ["g"], "t", "v", "maximize", "best").toPandas().sort_values("t")
    expected = pd.Series([v[2] for v in values], dtype="float64").cummax().ffill()
    assert np.allclose(got["best"].to_numpy(dtype=float), expected.to_numpy(), equal_nan=True)


# ------------------------------------------------------------------ quantiles


@pytest.mark.parametrize("small_rows", [10**6, 10])
def test_quantiles_with_heavy_ties(spark, small_rows):
    rng = np.random.default_rng(1)
    x = np.where(rng.random(5000) < 0.35, 3.0, rng.exponential(4, 5000))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": -np.round(x)}))
    shares = [0, 0.01, 0.2, 0.333, 0.5, 0.9, 1]
    got = quantiles.column_quantiles(
        df, {"x": shares, "y": shares}, small_rows=small_rows, accuracy=1000
    )
    assert np.allclose(got["x"], np.quantile(x, shares), rtol=1e-12)
    assert np.allclose(got["y"], np.quantile(-np.round(x), shares), rtol=1e-12)


@pytest.mark.parametrize("small_rows", [10**6, 20])
def test_group_quantiles_with_a_hot_group(rows, table, small_rows):
    got = quantiles.group_quantiles(table, "level", "x", [0.25, 0.5, 0.75], small_rows, 500)
    got = got.toPandas().set_index("level")
    expected = rows.groupby("level")["x"].quantile([0.25, 0.5, 0.75]).unstack()
    assert set(got.index) == set(expected.index)
    assert np.allclose(np.stack(got["q"]), expected.loc[got.index].to_numpy())


@pytest.mark.parametrize("small_rows,accuracy", [(0, 2), (40, 3)])
def test_quantiles_with_a_sketch_that_is_far_off(spark, small_rows, accuracy):
    """Skewed, tied, infinite and missing values; rounds only ever narrow."""
    rng = np.random.default_rng(8)
    parts = {
        "skewed": np.exp(rng.normal(0, 60, 500)), "tied": rng.integers(0, 3, 400).astype(float), "one": np.full(90, 2.5),
        "mixed": np.concatenate([np.full(200, -1.0), rng.normal(0, 1e-9, 150), [np.nan] * 30, [-np.inf, 1e300]]), "single": np.array([4.0]),
    }
    df = spark.createDataFrame(pd.DataFrame([(g, v) for g, x in parts.items() for v in x], columns=["g", "v"]))
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in quantiles.group_quantiles(df, "g", "v", shares, small_rows, accuracy).collect()}
    assert set(got) == set(parts)
    for g, x in parts.items():
        x = x[~np.isnan(x)]
        assert got[g]["n"] == len(x)
        assert np.allclose(got[g]["q"], np.quantile(x, shares), rtol=1e-12, atol=0) or np.isinf(x).any() and np.allclose(got[g]["q"][2:], np.quantile(x, shares[2:]), rtol=1e-12)
    wide = spark.createDataFrame(pd.DataFrame({"a": parts["skewed"], "b": np.resize(parts["tied"], 500)}))
    found = quantiles.column_quantiles(wide, {"a": [0.3], "b": [0.5, 0.99]}, small_rows=small_rows, accuracy=accuracy)
    assert np.allclose(found["a"], np.quantile(parts["skewed"], 0.3)) and np.allclose(found["b"], np.quantile(np.resize(parts["tied"], 500), [0.5, 0.99]))


@pytest.mark.parametrize("small_rows", [10**6, 50])
def test_quantiles_compute_their_input_once(spark, small_rows):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(3000).selectExpr("cast(id * 7 % 1000 as double) as x", "cast(id as double) as y").mapInArrow(counted, "x double, y double")
    shares = [0.0, 0.1, 0.333, 0.5, 1.0]
    found = quantiles.column_quantiles(df, {"x": shares, "y": shares}, small_rows=small_rows, accuracy=20)
    assert np.allclose(found["x"], np.quantile(np.arange(3000) * 7 % 1000, shares)) and np.allclose(found["y"], np.quantile(np.arange(3000), shares))
    assert read.value == 3000


@pytest.mark.parametrize("by_group", [False, True])
def test_brackets_of_one_row_are_small_after_the_first_round(spark, monkeypatch, by_group):
    written, settle = [], quantiles.settle

    def counted(df, name):
        out = settle(df, name)
        if name == "inside":
            written.append(out.count())
        return out

    monkeypatch.setattr(quantiles, "settle", counted)
    df = spark.range(20000).selectExpr("cast(id * 7 % 20000 as double) as x", "cast(id % 3 as double) as y", "'a' as g")
    shares = [0.25, 0.5, 0.9]
    if by_group:
        found = {"x": quantiles.group_quantiles(df, "g", "x", shares, small_rows=1).first()["q"]}
    else:
        found = quantiles.column_quantiles(df, {"x": shares, "y": shares}, small_rows=1)
        assert np.allclose(found["y"], np.quantile(np.arange(20000) % 3, shares))
    assert np.allclose(found["x"], np.quantile(np.arange(20000), shares))
    # every cut is a few ranks from a wanted one
    assert written and written[0] < 200


def test_quantiles_of_an_empty_column_beside_a_large_one(spark):
    df = spark.range(500).selectExpr("cast(id as double) as x", "cast(null as double) as y", "cast('nan' as double) as z")
    assert quantiles.column_quantiles(df, {"x": [0.5], "y": [0.5], "z": [0.5]}, small_rows=10, accuracy=10) == {"x": [249.5], "y": None, "z": None}


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert quantiles.column_quantiles(df, {"x": [0.5]}) == {"x": None}


@pytest.mark.parametrize("small_rows", [10**6, 10])
def test_bins_equal_qcut(rows, table, small_rows):
    bins = num.QuantileBins.fit(table, ["x", "count"], 100, {"count": 0}, small_rows=small_rows)
    got = by_id(bins.transform(table, as_text=False))
    x = pd.qcut(rows["x"], 100, duplicates="drop", labels=False)
    assert (got["x"] == x).all()
    masked = rows["count"] == 0
    expected = pd.qcut(rows.loc[~masked, "count"], 100, duplicates="drop", labels=False)
    assert (got.loc[~masked, "count"] == expected).all() and (got.loc[masked, "count"] == -1).all()


def test_bins_of_constant_and_all_sentinel_columns(spark):
    df = spark.createDataFrame([(i, 5.0, 0.0, None) for i in range(4)], "id long, a double, b double, c double")
    got = num.QuantileBins.fit(df, ["a", "b", "c"], 10, {"b": 0}).transform(df).collect()
    assert {(r["a"], r["b"], r["c"]) for r in got} == {("0", "-1", None)}


# -------------------------------------------------------------- target means


def naive_target_means(df, k=5):
    """From label sums and counts per level and fold, row by row."""
    cells: dict = {}
    for r in df.itertuples():
        if r.split == "train" and not pd.isna(r.level):
            s, n = cells.get((r.level, r.fold), (0.0, 0))
            cells[r.level, r.fold] = s + r.target, n + 1
    levels = {level for level, _ in cells}

    def without(level, f):
        parts = [v for (x, fold), v in cells.items() if x == level and fold != f]
        n = sum(n for _, n in parts)
        return sum(s for s, _ in parts) / n if n else np.nan

    known = {(x, f): without(x, f) for x in levels for f in range(k)}
    plain = [np.nanmean([known[x, f] for x in levels]) for f in range(k)]

    def encoded(r):
        if r.split == "train":
            return known.get((r.level, r.fold), np.nan)
        own = [known.get((r.level, f), np.nan) for f in range(k)]
        return np.mean([plain[f] if np.isnan(v) else v for f, v in enumerate(own)])

    return pd.Series([encoded(r) for r in df.itertuples()], index=df.index)


@pytest.mark.parametrize("max_rows", [1000, 0])
def test_target_means_equal_the_definition(table, max_rows):
    tagged = folds.stratified_folds(table)
    encoder = cat.TargetEncoder.fit(tagged, ["level"], max_rows=max_rows)
    got = by_id(encoder.transform(tagged, max_rows=max_rows))
    assert np.allclose(got["level_te"], naive_target_means(got), equal_nan=True)
    assert got.loc[got["id"] == 1, "level_te"].isna().all()


def test_target_mean_ignores_the_rows_own_label(table):
    tagged = folds.stratified_folds(table)
    flipped = tagged.withColumn("target", F.when(F.col("id") == 5, 1 - F.col("target")).otherwise(F.col("target")))
    a = by_id(cat.TargetEncoder.fit(tagged, ["level"]).transform(tagged))
    b = by_id(cat.TargetEncoder.fit(flipped, ["level"]).transform(flipped))
    assert a.loc[5, "level_te"] == b.loc[5, "level_te"]


# ------------------------------------------------------------------ encoders


@pytest.mark.parametrize("max_rows", [1000, 3])
def test_label_codes(rows, table, max_rows):
    got = by_id(cat.LabelCodes.fit(table, ["level"], max_rows=max_rows).transform(table))
    levels = sorted(rows["level"].dropna().unique())
    expected = rows["level"].map({v: str(i) for i, v in enumerate(levels)}).fillna(str(len(levels)))
    assert (got["level"] == expected).all()


def test_one_hot_with_odd_names(spark):
    df = spark.createDataFrame([(1, "a'b"), (2, "c\\d"), (3, "x.y z"), (4, None)], "id long, v string")
    hot = cat.OneHot.fit(df, ["v"])
    assert hot.names() == ["v_a'b", "v_c\\d", "v_x.y z", "v_nan"]
    got = by_id(hot.transform(df)).drop(columns="id")
    assert (got.to_numpy() == np.eye(4)).all()


def test_one_hot_of_unseen_level_is_zero(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    other = spark.createDataFrame([(3, "zz")], "id long, v string")
    assert cat.OneHot.fit(df, ["v"]).transform(other).drop("id").first().asDict() == {"v_a": 0.0, "v_b": 0.0}


def test_one_hot_refuses_too_many_levels(table):
    with pytest.raises(ValueError):
        cat.OneHot.fit(table, ["level"], max_columns=5)
    wide = cat.one_hot_vector(table, ["level"])
    vectors = [r["one_hot_level"] for r in wide.collect()]
    assert len(vectors) == 3000 and {v.numNonzeros() for v in vectors} == {1}
    assert {v.size for v in vectors} == {wide.select("one_hot_level").distinct().count()}


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(i, 0.1) for i in range(30)], "id long, v double")
    out = num.Standardizer.fit(df, ["v"]).transform(df)
    assert all(abs(r["v"]) < 1e-15 for r in out.collect())


def brute_exponent(x):
    def score(lam):
        up, down = x >= 0, x < 0
        t = np.empty_like(x)
        t[up] = np.log1p(x[up]) if lam == 0 else ((x[up] + 1) ** lam - 1) / lam
        t[down] = -np.log1p(-x[down]) if lam == 2 else -((1 - x[down]) ** (2 - lam) - 1) / (2 - lam)
        return -0.5 * np.log(t.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).mean()

    grid = np.arange(-3, 5, 0.01)
    best = grid[np.argmax([score(g) for g in grid])]
    fine = np.arange(best - 0.02, best + 0.02, 1e-5)
    return fine[np.argmax([score(g) for g in fine])]


def test_exponent_is_the_most_likely_one(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.lognormal(2, 1, 2000), "b": rng.normal(0, 3, 2000) ** 3 / 9, "c": 2.5})
    fit = num.YeoJohnson.fit(spark.createDataFrame(pdf).repartition(5), ["a", "b", "c"])
    for name in ("a", "b"):
        assert fit.exponents[name] == pytest.approx(brute_exponent(pdf[name].to_numpy()), abs=2e-5)
    assert fit.exponents["c"] == 1.0
    out = fit.transform(spark.createDataFrame(pdf)).toPandas()
    assert np.allclose(out[["a", "b"]].mean(), 0, atol=1e-9) and np.allclose(out[["a", "b"]].std(ddof=0), 1)
    assert np.allclose(out["c"], 0)


def test_power_keeps_order_and_zero(spark):
    df = spark.createDataFrame([(float(i),) for i in range(-20, 21)], "x double")
    for lam in (-1.0, 0.0, 0.5, 2.0, 3.0):
        y = [r[0] for r in df.orderBy("x").select(yeo_johnson(F.col("x"), lam)).collect()]
        assert y == sorted(y) and y[20] == 0


# --------------------------------------------------------------------- joins


@pytest.mark.parametrize("max_rows", [1000, 0])
def test_lookup_by_either_way(rows, table, max_rows):
    stats = table.where("level <> 'c3'").groupBy("level").agg(F.count("*").alias("rows"), F.avg("x").alias("m"))
    got = by_id(joins.lookup(table, stats, ["level"], ["m"], "rows", F.col("id"), max_rows=max_rows))
    means = rows[rows["level"] != "c3"].groupby("level")["x"].mean()
    assert len(got) == len(rows)
    assert np.allclose(got["m"].astype(float), rows["level"].map(means), equal_nan=True)


def test_blocks_must_hold_the_same_ids(table):
    a, b = table.select("id", "x"), table.select("id", "count")
    assert joins.side_by_side(a, b).count() == 3000
    with pytest.raises(PySparkException):
        joins.side_by_side(a, b.where("id <> 17")).collect()


def test_unmapped_label_fails(table):
    with pytest.raises(PySparkException):
        columns.map_label(table, "split", {"train": 1}).collect()


def test_strict_union_refuses_other_types(spark, table):
    with pytest.raises(ValueError):
        sets.union_strict(table.select("id"), table.select(F.col("id").cast("int")))


def test_split_round_trip(rows, table):
    train, test = sets.split_back(table)
    assert "target" not in test.columns
    back = by_id(sets.tag_union(train, test))
    assert (back["split"] == rows["split"]).all()
    assert back["target"].isna().sum() == (rows["split"] == "test").sum()


# ------------------------------------------------------------------- metrics


def naive_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    gap = pos[:, None] - neg[None, :]
    return ((gap > 0).sum() + 0.5 * (gap == 0).sum()) / gap.size


def test_auc_equals_all_pairs(rows, table):
    for score in ("x", "count"):
        got = metrics.auc(table, score, "target").first()["auc"]
        assert got == pytest.approx(naive_auc(rows["target"].to_numpy(), rows[score].to_numpy(float)))


def test_auc_does_not_depend_on_monotone_changes(table):
    a = metrics.auc(table, "x", "target").first()["auc"]
    b = metrics.auc(table.withColumn("x", F.exp(F.col("x") / 100)), "x", "target").first()["auc"]
    assert a == pytest.approx(b)


def test_auc_of_one_class_is_null_and_signed_zero_is_one_tie(spark):
    one = spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, s double")
    assert metrics.auc(one, "s", "y").first()["auc"] is None
    zero = spark.createDataFrame([(1, -0.0), (0, 0.0)], "y int, s double")
    assert metrics.auc(zero, "s", "y").first()["auc"] == 0.5


# ------------------------------------------------------------------- profile


def test_density_equals_numpy(rows, table):
    got = profile.density_by_category(table, "level", "x", points=50).toPandas()
    one = got[got["level"] == "hot"].sort_values("i")
    x = rows.loc[rows["level"] == "hot", "x"].to_numpy()
    h = x.std(ddof=1) * len(x) ** -0.2
    z = (one["x"].to_numpy()[:, None] - x[None, :]) / h
    expected = np.exp(-0.5 * z * z).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert np.allclose(one["density"], expected)
    assert "once" not in set(got["level"])


def test_correlations_of_pairs_with_gaps(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(1e6, 1, (500, 3)), columns=list("abc"))
    pdf.loc[::5, "a"] = np.nan
    pdf["same"] = 0.1
    got = profile.correlations(spark.createDataFrame(pdf), list("abc") + ["same"]).toPandas()
    got = got.pivot(index="col_a", columns="col_b", values="corr")
    assert np.allclose(got.loc[list("abc"), list("abc")].astype(float), pdf[list("abc")].corr().to_numpy(), atol=1e-9)
    assert got.loc["same"].isna().all()


def test_no_missing_gives_no_rows(table):
    assert profile.missing_report(table.select("id", "x")).count() == 0


def test_histogram_counts_every_row(rows, table):
    got = profile.histogram(table, ["x"], 30).toPandas().sort_values("bin")
    counts, _ = np.histogram(rows["x"], 30)
    assert (got["count"].to_numpy() == counts).all()


@pytest.mark.parametrize("small_rows", [10**6, 0])
def test_nan_is_missing_in_quantiles(spark, small_rows):
    values = [float(i) for i in range(400)] + [float("nan")] * 50 + [None] * 50
    df = spark.createDataFrame([(i, v, "g") for i, v in enumerate(values)], "id long, v double, g string")
    found = quantiles.column_quantiles(df, {"v": [0.0, 0.9, 1.0]}, small_rows=small_rows, accuracy=100)["v"]
    assert np.allclose(found, np.quantile(np.arange(400), [0.0, 0.9, 1.0]))
    row = quantiles.group_quantiles(df, "g", "v", [0.5, 1.0], small_rows=small_rows).first()
    assert row["n"] == 400 and np.allclose(row["q"], [199.5, 399.0])
    summary = profile.numeric_summary(df, ["v"], small_rows=small_rows).first()
    assert summary["count"] == 400 and summary["max"] == 399.0 and summary["p90"] == found[1]


def test_repeated_ids_do_not_multiply_rows(spark):
    a = spark.createDataFrame([(1, 1.0), (1, 2.0)], "id long, x double")
    b = spark.createDataFrame([(1, 3.0)], "id long, y double")
    for pair in ((a, b), (b, a)):
        with pytest.raises(PySparkException, match="id repeats"):
            joins.side_by_side(*pair).collect()


def test_binned_density_is_close_to_the_exact_one(spark):
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"id": np.arange(1500), "g": np.where(np.arange(1500) < 1000, "a", "b"), "v": np.concatenate([rng.normal(0, 1, 1000), rng.exponential(30, 500)])})
    df = spark.createDataFrame(frame)
    exact = profile.density_by_category(df, "g", "v").toPandas().set_index(["level", "i"])
    for width in (1 / 400, 1 / 40):
        got = profile.density_by_category(df, "g", "v", bin_width=width).toPandas().set_index(["level", "i"]).loc[exact.index]
        assert np.allclose(got["x"], exact["x"])
        for level, part in exact.groupby("level"):
            gap = (got.loc[part.index, "density"] - part["density"]).abs().max()
            assert gap <= width**2 / 8 * part["density"].max() * 4
    assert profile.density_by_category(df.where("id < 1"), "g", "v", bin_width=0.01).collect() == []
