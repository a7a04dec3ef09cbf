"""Models against closed forms or Newton steps, and properties of validation and search."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowloom.functions import metrics
from rowloom.operators import folds
from rowloom.plans import cv, ensemble, models, recipes, search
from rowloom.session import fresh_path
from rowloom.sources.stores import PredictionStore, TrialStore


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    n = 900
    x = rng.normal(0, 1, (n, 3))
    p = 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1])))
    return pd.DataFrame(
        {
            "id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2],
            "kind": np.where(x[:, 2] > 0, "up", "down"),
            "split": np.where(np.arange(n) % 5 == 0, "test", "train"),
            "target": (rng.random(n) < p).astype(int),
            "y": 2 * x[:, 0] + x[:, 2] + rng.normal(0, 0.1, n) + 3,
        }
    )


@pytest.fixture(scope="module")
def table(spark, rows):
    return folds.stratified_folds(spark.createDataFrame(rows)).persist()


def numbers_only(table):
    return table.select("id", "split", "fold", "target", "a", "b", "c")


def test_logistic_equals_newton(rows, table):
    p = models.prepare(numbers_only(table), models.LEARNERS["logreg"])
    stats = cv.fold_stats(p, cv.DEFAULT)[None]
    train = p.data.where("split = 'train'")
    fit = models.LEARNERS["logreg"].estimator({"C": 0.5, "tol": 1e-10}, stats, 1).setLabelCol("target").fit(train)
    part = rows[rows["split"] == "train"]
    x = np.column_stack([part[["a", "b", "c"]], np.ones(len(part))])
    y, w, ridge = part["target"].to_numpy(), np.zeros(4), np.diag([1 / 0.5] * 3 + [0])
    for _ in range(30):
        mu = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (mu * (1 - mu))[:, None]).T @ x + ridge, x.T @ (mu - y) + ridge @ w)
    assert np.allclose([*fit.coefficients, fit.intercept], w, atol=1e-5)


def test_ridge_equals_closed_form(rows, table, spark):
    df = table.drop("target", "kind").withColumnRenamed("y", "target")
    p = models.prepare(df, models.LEARNERS["ridge"])
    stats = cv.fold_stats(p, cv.DEFAULT)[2]
    fit = models.LEARNERS["ridge"].estimator({"alpha": 40.0}, stats, 1).setLabelCol("target").fit(
        p.data.where("split = 'train' and fold <> 2")
    )
    fold = df.select("id", "fold").toPandas().set_index("id")["fold"]
    part = rows[(rows["split"] == "train") & (rows["id"].map(fold) != 2)]
    assert stats.rows == len(part) and stats.label_deviation == pytest.approx(part["y"].std(ddof=0))
    x, y = part[["a", "b", "c"]].to_numpy(), part["y"].to_numpy()
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 40 * np.eye(3), xc.T @ yc)
    assert np.allclose(fit.coefficients.toArray(), w, atol=1e-6)


@pytest.mark.parametrize(
    "name, params", [
        ("gbt", {"rounds": 3, "max_depth": 3}), ("rf_clf", {"n_estimators": 5, "max_depth": 4}),
        ("gbt_categorical", {"rounds": 3, "max_depth": 3}),
    ],
)
def test_oof_covers_each_train_row_once(table, rows, name, params):
    result = cv.cross_validate(table.drop("y"), name, params)
    oof, test = result.oof.toPandas(), result.test.toPandas()
    assert sorted(oof["id"]) == sorted(rows.loc[rows["split"] == "train", "id"])
    assert sorted(test["id"]) == sorted(rows.loc[rows["split"] == "test", "id"])
    assert oof["pred"].between(0, 1).all() and test["pred"].between(0, 1).all()
    assert metrics.auc(result.oof, "pred", "target").first()["auc"] > 0.7
    summary = result.summary().first()
    values = [r["value"] for r in result.scores.collect()]
    assert summary["mean"] == pytest.approx(np.mean(values)) and summary["std"] == pytest.approx(np.std(values))
    result.prepared.release()


def test_left_out_label_does_not_reach_its_prediction(table):
    base = numbers_only(table)
    target = F.when(F.col("id") == 7, 1 - F.col("target")).otherwise(F.col("target"))
    a = cv.cross_validate(base, "logreg").oof.where("id = 7").first()["pred"]
    b = cv.cross_validate(base.withColumn("target", target), "logreg").oof.where("id = 7").first()["pred"]
    assert a == pytest.approx(b, abs=1e-9)


def test_perceptron_learns(table):
    result = cv.cross_validate(numbers_only(table), "mlp", {"hidden_dims": [4], "epochs": 40})
    assert metrics.auc(result.oof, "pred", "target").first()["auc"] > 0.75


def test_weights_count(spark, table):
    """Rows of weight zero must not matter to a weighted learner."""
    noise = table.withColumn("weight", F.when(F.col("id") % 2 == 0, 0.0).otherwise(1.0))
    flipped = noise.withColumn("target", F.when(F.col("weight") == 0, 1 - F.col("target")).otherwise(F.col("target")))
    p = models.prepare(flipped.drop("y"), models.LEARNERS["gbt"])
    assert "weight" in p.data.columns
    stats = cv.fold_stats(p, cv.DEFAULT)[None]
    fit = cv._fit(models.LEARNERS["gbt"], {"rounds": 5, "max_depth": 3}, stats, p.data.where("split='train'"), cv.DEFAULT, 1)
    score = models.LEARNERS["gbt"].score_column(fit)
    odd = fit.transform(p.data.where("split='train' and weight = 1")).select("target", score.alias("pred"))
    assert metrics.auc(odd, "pred", "target").first()["auc"] > 0.7


def test_parameter_names():
    gbt = models.LEARNERS["gbt"]
    assert gbt.resolve({"subsample": 0.5})["row_share"] == 0.5
    with pytest.warns(UserWarning):
        gbt.resolve({"reg_lambda": 1.0})
    with pytest.raises(ValueError):
        gbt.resolve({"no_such": 1})
    leaves = models.LEARNERS["gbt_leafwise"].estimator({"num_leaves": 9}, models.TrainStats(10, 1.0, 2), 1)
    assert leaves.getMaxDepth() == 4


def test_pipeline_of_a_fold_saves_and_loads(spark, table):
    from rowloom.sources.stores import load_model, save_model

    result = cv.cross_validate(numbers_only(table), "ridge")
    path = fresh_path(spark, "m")
    save_model(result.pipeline(1), path)
    rows = numbers_only(table)
    a = result.pipeline(1).transform(rows).select("id", "prediction").toPandas().sort_values("id")
    b = load_model(path).transform(rows).select("id", "prediction").toPandas().sort_values("id")
    assert np.allclose(a["prediction"], b["prediction"])


def test_linear_learner_refuses_text(table):
    with pytest.raises(ValueError):
        models.prepare(table, models.LEARNERS["logreg"])


def test_first_best():
    assert cv.first_best([5, 4, 4.5, 4.2, 3, 9], 2) == 1
    assert cv.first_best([5, 4, 4.5, 4.2, 3, 9], 3) == 4
    assert cv.first_best([1.0], 5) == 0


def test_early_stop_table_agrees_with_the_loop(spark):
    rng = np.random.default_rng(4)
    curves = {m: np.cumsum(rng.normal(-0.01, 0.2, 80)).round(3) for m in "abcd"}
    df = spark.createDataFrame(
        [(m, i, float(v)) for m, c in curves.items() for i, v in enumerate(c)], "m string, i int, loss double"
    )
    for patience in (1, 3, 10, 100):
        got = {r["m"]: r["best_iteration"] for r in cv.early_stop_pick(df, ["m"], "i", "loss", patience).collect()}
        assert got == {m: cv.first_best(list(c), patience) for m, c in curves.items()}


def test_best_fold_follows_the_direction(spark):
    scores = spark.createDataFrame([(0, 0.4), (1, 0.9), (2, 0.2)], "fold int, value double")
    assert cv.best_fold(scores, "auc").first()["fold"] == 1
    assert cv.best_fold(scores, "logloss").first()["fold"] == 2


# --------------------------------------------------------------------- search


def test_search_resumes_and_starts_with_given_parameters(spark, table):
    store = TrialStore(spark, fresh_path(spark, "t"))
    seen = []

    def objective(params):
        seen.append(params)
        if params["C"] == 7.0:
            raise RuntimeError("no")
        return params["C"]

    space = search.SPACES["logreg"]
    search.run_search(objective, space, 2, store, "s", initial={"C": 7.0})
    trials = search.run_search(objective, space, 2, store, "s")
    assert [r["trial"] for r in trials.orderBy("trial").collect()] == [0, 1, 2, 3]
    assert seen[0] == {"C": 7.0} and len({p["C"] for p in seen}) == 4
    assert trials.where("state = 'fail'").count() == 1
    best = search.top_trials(trials, 1, "logloss").first()
    assert best["value"] == min(p["C"] for p in seen[1:])
    store.delete("s")
    assert store.load("s").count() == 0


def test_candidates_stay_in_range(spark):
    trials = spark.range(500).withColumnRenamed("id", "trial")
    got = search.candidates(trials, search.SPACES["mlp"]).toPandas()
    assert got["hidden_dim1"].between(256, 1024).all() and (got["hidden_dim1"] % 32 == 0).all()
    for a, b in (("hidden_dim1", "hidden_dim2"), ("hidden_dim2", "hidden_dim3"), ("hidden_dim3", "hidden_dim4")):
        assert (got[a] >= got[b]).all()
    assert got["lr"].between(1e-3, 1e-1).all()
    leafwise = search.candidates(trials, search.SPACES["gbt_leafwise"]).toPandas()
    assert (leafwise["max_depth"] >= np.floor(np.log2(leafwise["num_leaves"])) + 1).all()


# ------------------------------------------------------------------- ensemble


def long_preds(spark, seed=0, n=700):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.4).astype(int)
    preds = {f"m{i}": np.clip(y * 0.1 * i + rng.random(n), 0, 1.5) for i in range(3)}
    long = pd.concat([pd.DataFrame({"id": np.arange(n), "model_id": m, "pred": p, "split": "train"}) for m, p in preds.items()])
    labels = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "target": y}))
    return spark.createDataFrame(long), labels, preds, y


def test_weight_search_finds_the_exact_best(spark, monkeypatch):
    long, labels, preds, y = long_preds(spark)
    ids = ["m0", "m1", "m2"]
    drawn = ensemble.weight_candidates(spark.range(60).withColumnRenamed("id", "trial"), ids)
    monkeypatch.setattr(ensemble, "BLOCK_CELLS", 32 * 25)  # three blocks of candidates
    got = ensemble.search_weights(long, labels, ids, drawn, top_k=7, bins=32).collect()
    weights = drawn.toPandas().set_index("trial")[["w0", "w1", "w2"]]
    assert np.allclose(weights.sum(axis=1), 1)

    def auc(w):
        s = sum(w[i] * preds[m] for i, m in enumerate(ids))
        gap = s[y == 1][:, None] - s[y == 0][None, :]
        return ((gap > 0).sum() + 0.5 * (gap == 0).sum()) / gap.size

    exact = weights.apply(lambda r: auc(r.to_numpy()), axis=1).sort_values(ascending=False)
    assert [r["trial"] for r in got] == list(exact.index[:7])
    assert np.allclose([r["auc"] for r in got], exact.iloc[:7])


def test_blend_ignores_the_scale_of_weights(spark):
    long, *_ = long_preds(spark)
    a = ensemble.weighted_blend(long, {"m0": 1, "m2": 3}).toPandas().sort_values("id")
    b = ensemble.weighted_blend(long, {"m0": 10, "m2": 30}).toPandas().sort_values("id")
    assert np.allclose(a["pred"], b["pred"])
    with pytest.raises(ValueError):
        ensemble.weighted_blend(long, {"m0": 0.0, "m2": 0.0})


def test_blend_refuses_missing_predictions(spark):
    long, *_ = long_preds(spark)
    with pytest.raises(Exception, match="no prediction"):
        ensemble.weighted_blend(long.where("not (id = 3 and model_id = 'm0')"), {"m0": 1, "m2": 3}).collect()


def test_prediction_store_replaces_only_its_part(spark):
    store = PredictionStore(spark, fresh_path(spark, "p"))
    df = spark.range(5).select("id", F.lit(0.5).alias("pred"))
    store.save(df, "base", "1", "oof")
    store.save(df, "base", "2", "oof")
    store.save(df.withColumn("pred", F.lit(0.9)), "base", "2", "oof")
    got = store.load("base", ["1", "2"], "oof").groupBy("model_id").agg(F.max("pred"), F.count("*")).collect()
    assert sorted(tuple(r) for r in got) == [("1", 0.5, 5), ("2", 0.9, 5)]


# -------------------------------------------------------------------- recipes


@pytest.mark.parametrize("version", sorted(recipes.FEATURE_SETS))
def test_every_feature_set_builds(spark, version):
    rng = np.random.default_rng(1)
    n = 400
    raw = pd.DataFrame(
        {
            "id": np.arange(n), "age": rng.integers(18, 90, n), "job": rng.choice(list("abcd"), n),
            "default": rng.choice(["yes", "no"], n), "loan": rng.choice(["yes", "no"], n),
            "balance": rng.normal(500, 900, n).round(), "day": rng.integers(1, 31, n),
            "duration": rng.exponential(200, n).round(), "campaign": rng.poisson(2, n),
            "pdays": np.where(rng.random(n) < 0.6, -1, rng.integers(1, 400, n)), "previous": rng.poisson(1, n),
            "y": rng.integers(0, 2, n),
        }
    )
    train, test = raw[:300], raw[300:].drop(columns="y")
    original = raw[:50].copy()
    original["id"], original["y"] = -original["id"] - 1, np.where(original["y"] == 1, "yes", "no")
    out = recipes.feature_set(
        *[spark.createDataFrame(p) for p in (train, test)], version, spark.createDataFrame(original)
    )
    got = out.toPandas()
    extra = 50 if recipes.FEATURE_SETS[version][0] == 2 else 0
    assert len(got) == n + extra and got["id"].is_unique
    assert got.loc[got["split"] == "test", "target"].isna().all()
    assert got.loc[got["split"] == "train", "target"].notna().all()
    assert not [c for c in got.columns if "_target" in c or "target_" in c]
    if recipes.FEATURE_SETS[version][1] == 3:
        assert not [c for c in got.columns if c.startswith("default")]


def test_search_stores_what_was_fitted(spark, table):
    df = folds.plain_folds(table.select("id", "split", "a", "b", F.col("y").alias("target")))
    store = TrialStore(spark, fresh_path(spark, "t"))
    with pytest.raises(ValueError, match="are searched"):
        search.search_model(df, "ridge", 1, store, fixed={"alpha": 3.0})
    trials = search.search_model(df, "ridge", 2, store, study="r", fixed={"fit_intercept": False}).collect()
    for r in trials:
        assert r["params"]["fit_intercept"] == "False"
        _, value, _ = cv.fit_one_fold(df, "ridge", {"alpha": float(r["params"]["alpha"]), "fit_intercept": False})
        assert value == pytest.approx(r["value"], abs=1e-9)


def test_search_appends_each_trial(spark):
    store = TrialStore(spark, fresh_path(spark, "t"))
    stored = []

    def objective(params):
        stored.append(store.load("s").count())
        if len(stored) == 3:
            raise KeyboardInterrupt
        return 1.0, {"C": 5.0}

    with pytest.raises(KeyboardInterrupt):
        search.run_search(objective, search.SPACES["logreg"], 5, store, "s")
    assert stored == [0, 1, 2]
    assert {r["params"]["C"] for r in store.load("s").collect()} == {"5.0"}


def test_model_names_stay_texts(spark):
    store = PredictionStore(spark, fresh_path(spark, "p"))
    one = spark.createDataFrame([(1, 0.5)], "id long, pred double")
    for name in ("01", "1", "it's/a b"):
        store.save(one, "l1", name, "oof")
    assert {r["model_id"] for r in store.load("l1", ["01", "1", "it's/a b"], "oof").collect()} == {"01", "1", "it's/a b"}
    assert store.load("l1", ["01"], "oof").count() == 1


def test_several_classes_are_scored_alike(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 4, 400)
    x = rng.normal(size=(400, 3)) + np.eye(4)[y][:, :3]
    data = pd.DataFrame({"id": np.arange(400), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "target": y, "split": "train"})
    df = folds.stratified_folds(spark.createDataFrame(data))
    result = cv.cross_validate(df, "logreg", {"C": 1.0})
    oof = result.oof.toPandas()
    p = np.clip(np.stack(oof["pred"]), 1e-15, 1 - 1e-15)
    oof["loss"] = -np.log(p[np.arange(len(p)), oof["target"].astype(int)])
    assert result.summary().first()["oof_score"] == pytest.approx(oof["loss"].mean(), abs=1e-6)
    _, value, _ = cv.fit_one_fold(df, "logreg", {"C": 1.0}, fold=2)
    assert value == pytest.approx(oof[oof["fold"] == 2]["loss"].mean(), abs=1e-4)
    result.release()


def test_limits_are_errors(spark, table):
    with pytest.raises(ValueError, match="at most 30"):
        models.LEARNERS["rf_clf"].resolve({"max_depth": 31})
    with pytest.raises(ValueError, match="levels"):
        models.prepare(table.select("id", "split", "target", "kind"), models.LEARNERS["gbt"], max_levels=2)
    assert models.LEARNERS["mlp"].resolve({"lr": 0.1})["solver"] == "gd"
