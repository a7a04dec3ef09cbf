"""Registered queries: training, validation, search and ensembling."""

from __future__ import annotations

import math
from functools import partial

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from catalog import features as fq
from catalog import fixtures as fx
from catalog import scores as sq
from rowloom.functions import metrics
from rowloom.layout import Layout
from rowloom.operators import categories as cat
from rowloom.operators import folds
from rowloom.operators import numeric as num
from rowloom.plans import cv, ensemble, importance, models, search
from rowloom.session import fresh_path, settle
from rowloom.sources import bucketed, stores

PLANTED = fx.PLANTED
# small settings, so that every model is fitted on the whole table in seconds
QUICK = {
    "gbt": {"rounds": 5, "max_depth": 3, "max_bin": 64},
    "gbt_leafwise": {"rounds": 4, "num_leaves": 8, "max_bin": 64},
    "gbt_categorical": {"rounds": 4, "max_depth": 3, "max_bin": 64},
    "logreg": {},
    "ridge": {},
    "rf_clf": {"n_estimators": 8, "max_depth": 5},
    "rf_reg": {"n_estimators": 8, "max_depth": 5},
    "mlp": {"hidden_dims": [8], "epochs": 30},
}


def tree_table(spark, sf):
    df = fx.campaign(spark, sf).drop("target")
    return folds.stratified_folds(df, layout=PLANTED)


def dense_table(spark, sf):
    """Encoded and scaled columns only, for models that need numbers."""
    # the folds read their rows more than once
    df = settle(fx.campaign(spark, sf).drop("target"), "campaign")
    df = settle(folds.stratified_folds(df, layout=PLANTED), "folds")
    text = ["segment", "nation", "status"]
    df = cat.TargetEncoder.fit(df, text, layout=PLANTED).transform(df, PLANTED)
    df = cat.OneHot.fit(df, ["returned"], drop_first=True).transform(df).drop(*text)
    numbers = ["price", "balance", "n_items", "qty", "ship_gap", *[f"{c}_te" for c in text]]
    return num.Standardizer.fit(df, numbers).transform(df)


def value_table(spark, sf):
    """A continuous label: the price, from the other columns."""
    df = fx.campaign(spark, sf).drop("target", "target_planted")
    df = df.withColumn("target", (F.col("price") + 20 * F.col("balance")) / 100000)
    return folds.plain_folds(df.drop("price", "status", "segment", "nation", "returned"))


def input_table(model, spark, sf):
    learner = models.LEARNERS[model]
    if not learner.classifier:
        return value_table(spark, sf), Layout()
    return (tree_table if learner.trees else dense_table)(spark, sf), PLANTED


def _sound(learner):
    """A probability for classifiers, else a number."""
    p = F.col("pred")
    return p.between(0, 1) if learner.classifier else p.isNotNull() & ~F.isnan(p)


def oof(model, spark, sf):
    """Out-of-fold predictions of train rows and averaged predictions of test rows: each row once, with a sound value."""
    df, layout = input_table(model, spark, sf)
    learner = models.LEARNERS[model]
    patience = 2 if learner.boosted else None
    result = cv.cross_validate(df, model, QUICK[model], layout, patience=patience)
    test = result.test.select("id", F.lit("test").alias("part"), F.lit(None).cast("int").alias("fold"), "pred")
    both = result.oof.select("id", F.lit("oof").alias("part"), "fold", "pred").unionByName(test)
    return both.select("id", "part", "fold", _sound(learner).alias("sound"))


def one_fold(model, spark, sf):
    """The score of fold 0: of which metric, whether it beats a constant guess, whether the kept round was run."""
    df, layout = input_table(model, spark, sf)
    learner = models.LEARNERS[model]
    patience = 2 if learner.boosted else None
    df = settle(df, "one-fold")
    _, value, best = cv.fit_one_fold(df, model, QUICK[model], 0, layout, patience=patience)
    held = df.where("split = 'train' and fold = 0")
    share, spread, n = held.agg(F.avg(layout.label), F.stddev_pop(layout.label), F.count("*")).first()
    bar = {"auc": 0.5, "logloss": -share * math.log(share) - (1 - share) * math.log(1 - share) if learner.classifier else None, "rmse": spread}
    better = value > bar["auc"] if learner.metric == "auc" else value < bar[learner.metric] * 1.02
    row = (model, learner.metric, n, bool(better), best is None or 1 <= best <= QUICK[model]["rounds"])
    return spark.createDataFrame([row], "model string, metric string, rows bigint, no_worse_than_constant boolean, round_was_run boolean")


def one_fold_logreg_multiclass(spark, sf):
    """Ten classes on one fold: the score is the log-loss of the right class's probability, as in the whole run."""
    df = settle(folds.stratified_folds(_ten_classes(spark, sf)), "folds")
    _, value, _ = cv.fit_one_fold(df, "logreg", {"C": 0.1})
    result = cv.cross_validate(df, "logreg", {"C": 0.1})
    whole = {r["fold"]: r["value"] for r in result.scores.collect()}
    summary = result.summary().first()
    row = (abs(value - whole[0]) < 1e-6, summary["folds"], min(whole.values()) <= summary["oof_score"] <= max(whole.values()))
    result.release()
    return spark.createDataFrame([row], "same_as_whole_run boolean, folds bigint, summary_within_folds boolean")


def _ten_classes(spark, sf):
    return fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("target"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(64)],
        F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train").alias("split"),
    )


def oof_logreg_multiclass(spark, sf):
    """Ten classes: a probability per class, ten of them, that add up to one."""
    result = cv.cross_validate(folds.stratified_folds(_ten_classes(spark, sf)), "logreg", {"C": 0.1})
    total = F.aggregate("pred", F.lit(0.0), lambda a, b: a + b)
    return result.oof.select("id", "fold", F.size("pred").alias("classes"), (F.abs(total - 1) < 1e-9).alias("sound"))


def oof_ridge_univariate(spark, sf):
    df = fx.campaign(spark, sf).select(
        "id", "split", (F.col("balance") / 1000).alias("x"), (F.col("price") / 100000).alias("target")
    )
    result = cv.cross_validate(folds.plain_folds(df), "ridge", {"alpha": 500.0})
    return result.oof.select("id", "fold", F.round("pred", 6).alias("pred"))


def ridge_univariate(spark, sf):
    """Weight and intercept of one ridge fit on all train rows, read off two predictions."""
    df = fx.campaign(spark, sf).where("split = 'train'").select(
        "id", "split", (F.col("balance") / 1000).alias("x"), (F.col("price") / 100000).alias("target"),
        F.lit(0).alias("fold"),
    )
    p = models.prepare(df, models.LEARNERS["ridge"])
    stats = cv.fold_stats(p, Layout())[None]
    fit = models.LEARNERS["ridge"].estimator({"alpha": 500.0}, stats, 42).setLabelCol("target").fit(p.data)
    row = (round(float(fit.coefficients[0]), 8), round(float(fit.intercept), 8))
    p.release()
    return spark.createDataFrame([row], "weight double, intercept double")


# one split, whose place and leaves SQL can work out: (learner, feature, parameters)
STUMPS = {
    "gbt": ("step", {"rounds": 1, "max_depth": 1, "min_rows": 1, "column_share": 1.0, "row_share": 1.0}),
    "gbt_leafwise": ("step", {"rounds": 1, "num_leaves": 2, "min_rows": 1, "column_share": 1.0, "row_share": 1.0}),
    "gbt_categorical": ("segment", {"rounds": 1, "max_depth": 1}),
    "rf_clf": ("step", {"n_estimators": 1, "max_depth": 1, "bootstrap": False}),
    "rf_reg": ("n_items", {"n_estimators": 1, "max_depth": 1, "bootstrap": False}),
}


def stump(model, spark, sf):
    """Out-of-fold and test predictions of models with a single split of one feature."""
    feature, params = STUMPS[model]
    df, layout = input_table(model, spark, sf)
    if feature == "step":
        df = df.withColumn("step", F.floor(F.col("price") / 50000))
    df = df.select("id", "split", "fold", layout.label, feature)
    result = cv.cross_validate(df, model, params, layout)
    out = result.oof.select("id", "fold", F.round("pred", 9).alias("pred"))
    return out.unionByName(result.test.select("id", F.lit(None).cast("int").alias("fold"), F.round("pred", 9).alias("pred")))


def logreg_saturated(spark, sf):
    """A weight per group and next to no penalty: the probability is the group's share in the other folds."""
    df = tree_table(spark, sf).select("id", "split", "fold", "target_planted", (F.col("returned") == "yes").cast("double").alias("x"))
    result = cv.cross_validate(df, "logreg", {"C": 1e9, "tol": 1e-12}, PLANTED)
    return result.oof.select("id", "fold", F.round("pred", 6).alias("pred"))


def full_train(spark, sf):
    """Full fit with a quarter more rounds, saved to and read from the prediction store."""
    preds = cv.full_train(tree_table(spark, sf), "gbt", 4.6, QUICK["gbt"], PLANTED)
    store = stores.PredictionStore(spark, fresh_path(spark, "preds"))
    store.save(preds, "l1", "gbt", "test_full")
    return store.load("l1", ["gbt"], "test_full").select("model_id", "id", _sound(models.LEARNERS["gbt"]).alias("sound"))


def model_roundtrip(spark, sf):
    """Rows whose prediction changes when the model is saved and loaded."""
    p = models.prepare(dense_table(spark, sf), models.LEARNERS["logreg"], PLANTED)
    stats = cv.fold_stats(p, PLANTED)[None]
    rows = p.data.where("split = 'train'")
    fit = models.LEARNERS["logreg"].estimator({}, stats, 42).setLabelCol("target_planted").fit(rows)
    path = fresh_path(spark, "model")
    stores.save_model(PipelineModel(stages=[fit]), path)
    loaded = stores.load_model(path)
    score = models.LEARNERS["logreg"].score_column(fit)
    before = fit.transform(p.data).select("id", "split", "features", score.alias("before"))
    both = loaded.transform(before).select("split", "before", score.alias("after"))
    return both.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.abs(F.col("before") - F.col("after")) > 1e-12).alias("n_changed"),
    )


def gain_importance(spark, sf):
    p = models.prepare(tree_table(spark, sf), models.LEARNERS["gbt"], PLANTED)
    stats = cv.fold_stats(p, PLANTED)[None]
    rows = p.data.where("split = 'train'")
    fit = models.LEARNERS["gbt"].estimator(QUICK["gbt"], stats, 42).setLabelCol("target_planted").fit(rows)
    p.release()
    shares = cv.gain_importance(fit, p.names, spark)
    return _told_by(shares, "importance").withColumn("adds_up", F.lit(abs(shares.agg(F.sum("importance")).first()[0] - 100) < 0.1))


def _told_by(table, value):
    """How many features a table of importances has, and the first: the label was planted on the price most of all."""
    return table.agg(F.count(F.lit(1)).alias("features"), F.max_by("feature", value).alias("first"))


def permutation_importance(spark, sf):
    learner = models.LEARNERS["gbt"]
    p = models.prepare(tree_table(spark, sf), learner, PLANTED)
    stats = cv.fold_stats(p, PLANTED)[0]
    train = p.data.where("split = 'train'")
    fit = learner.estimator(QUICK["gbt"], stats, 42).setLabelCol("target_planted").fit(train.where("fold <> 0"))
    drops = importance.permutation_importance(fit, p, learner, train.where("fold = 0"), PLANTED)
    p.release()
    return _told_by(drops, "drop")


def flagship(spark, sf):
    df = settle(folds.stratified_folds(fx.campaign(spark, sf).drop("target"), layout=PLANTED), "folds")
    text = ["segment", "nation", "status"]
    df = cat.TargetEncoder.fit(df, text, layout=PLANTED).transform(df, PLANTED).drop(*text, "returned")
    numbers = ["price", "balance", "n_items", "qty", "ship_gap", *[f"{c}_te" for c in text]]
    df = num.Standardizer.fit(df, numbers).transform(df)
    result = cv.cross_validate(df, "logreg", layout=PLANTED)
    return metrics.auc(result.oof, "pred", "target_planted", ["fold"])


# ------------------------------------------------ arithmetic around the models


def fold_average(spark, sf):
    """Average over models kept as columns, as done with the fold models' predictions."""
    wide = fx.preds(spark, sf).where("split = 'test'").groupBy("id").pivot(
        "model_id", ["m1", "m2", "m3"]
    ).agg(F.first("pred"))
    return wide.select("id", F.round(cv.fold_average([F.col(m) for m in ("m1", "m2", "m3")]), 9).alias("pred"))


def _fold_scores(spark, sf, metric, score, label):
    return metrics.score_table(sq.scored(spark, sf), metric, score, label, ["fold"])


def cv_summary(spark, sf):
    rows = sq.scored(spark, sf)
    scores = metrics.score_table(rows, "auc", "p", "target", ["fold"])
    out = cv.cv_summary(scores, rows, "auc", value="p")
    return out.select("folds", *[F.round(c, 9).alias(c) for c in ("mean", "std", "oof_score")])


def best_fold(spark, sf):
    """Largest score for a metric that rises, smallest for one that falls."""
    out = None
    for metric, score, label in (("auc", "p", "target"), ("logloss", "p", "target"), ("rmse", "guess", "y")):
        best = cv.best_fold(_fold_scores(spark, sf, metric, score, label), metric)
        best = best.select(F.lit(metric).alias("metric"), "fold", F.round("value", 6).alias("value"))
        out = best if out is None else out.unionByName(best)
    return out


def early_stop_pick(spark, sf):
    """Loss curves out of lineitem: average discount by day of the year, one per flag pair."""
    losses = fx.table(spark, sf, "lineitem").groupBy(
        F.concat("l_returnflag", "l_linestatus").alias("model"),
        F.dayofyear("l_shipdate").alias("iteration"),
    ).agg(F.round(F.avg("l_discount"), 9).alias("loss"))
    return cv.early_stop_pick(losses, ["model"], "iteration", "loss", 10)


# ------------------------------------------------------------------- search

SPACE = (
    search.Dim("rate", low=0.01, high=0.3),
    search.Dim("penalty", low=1e-4, high=40.0, log=True),
    search.Dim("depth", "int", 3, 30),
    search.Dim("width", "int", 256, 1024, step=32),
    search.Dim("width2", "int", 128, step=32, below="width"),
    search.Dim("dropout", low=0.1, high=0.4, step=0.05),
    search.Dim("activation", "choice", choices=("ReLU", "LeakyReLU", "GELU", "SiLU")),
    search.Dim("min_depth", sql="greatest(depth, cast(floor(log2(width)) as bigint) + 1)"),
)


def candidate_table(spark, sf):
    trials = fx.trials(spark, sf).select("trial")
    out = search.candidates(trials, SPACE)
    return out.select("trial", *[
        F.round(d.name, 9).alias(d.name) if d.kind == "float" and not d.sql else F.col(d.name) for d in SPACE
    ])


def topk_trials(spark, sf):
    return search.top_trials(fx.trials(spark, sf), 10, "auc")


def topk_trials_loss(spark, sf):
    return search.top_trials(fx.trials(spark, sf), 10, "rmse")


def trial_history(spark, sf):
    up = search.trial_history(fx.trials(spark, sf), "auc").withColumnRenamed("best_so_far", "best_max")
    down = search.trial_history(fx.trials(spark, sf), "logloss")
    return up.select("study", "trial", "value", "best_max").join(
        down.select("trial", F.col("best_so_far").alias("best_min")), "trial"
    )


def param_influence(spark, sf):
    out = search.parameter_influence(fx.trials(spark, sf), ["max_depth", "trial"], ["activation"])
    return out.select("param", F.round("influence", 8).alias("influence"))


GRID = tuple(d for d in SPACE if not d.below and d.name not in ("min_depth", "width"))


def candidate_grid(spark, sf):
    """The points of a grid whose numbers the study has, decoded from them."""
    trials = fx.trials(spark, sf).select((F.col("trial") * 7).alias("trial"))
    out = search.grid_candidates(trials, GRID, 4)
    return out.select("trial", *[F.round(d.name, 9).alias(d.name) if d.kind == "float" else F.col(d.name) for d in GRID])


def param_influence_rank(spark, sf):
    """Correlation of ranks, ties averaged."""
    out = search.parameter_influence(fx.trials(spark, sf), ["max_depth", "trial"], ranks=True)
    return out.select("param", F.round("influence", 8).alias("influence"))


# what is not searched
SEARCH_FIXED = {
    "gbt": {"rounds": 2, "max_bin": 32}, "gbt_leafwise": {"rounds": 2, "max_bin": 32},
    "gbt_categorical": {"rounds": 2}, "mlp": {"epochs": 10},
}
# a user's own ranges, in which a trial is fitted in seconds
SEARCH_SPACES = {
    "gbt": (
        search.Dim("learning_rate", low=0.01, high=0.3), search.Dim("max_depth", "int", 2, 5),
        search.Dim("min_rows", low=1, high=100), search.Dim("column_share", low=0.3, high=0.6),
        search.Dim("row_share", low=0.5, high=0.9),
    ),
    "gbt_leafwise": (
        search.Dim("num_leaves", "int", 4, 32), search.Dim("min_rows", "int", 1, 200),
        search.Dim("min_gain", low=1e-5, high=1e-2, log=True), search.Dim("column_share", low=0.3, high=1.0),
    ),
    "gbt_categorical": (search.Dim("max_depth", "int", 2, 5), search.Dim("min_rows", low=10, high=100), search.Dim("max_bin", "int", 128, 255)),
    "logreg": search.SPACES["logreg"],
    "ridge": search.SPACES["ridge"],
    "rf_clf": (search.Dim("n_estimators", "int", 3, 9), search.Dim("max_depth", "int", 2, 6)),
    "rf_reg": (search.Dim("n_estimators", "int", 3, 9), search.Dim("max_depth", "int", 2, 6)),
    "mlp": (search.Dim("block_size", "int", 64, 512, step=32), search.Dim("lr", low=1e-3, high=1e-1, log=True)),
}


def search_model(model, spark, sf):
    """Three candidates on one fold, the search resumed once for the third: what each fit used.

    A row per trial and searched parameter.
    """
    df, layout = input_table(model, spark, sf)
    # the search and its resumption read the same table
    df = settle(df, "table")
    store = stores.TrialStore(spark, fresh_path(spark, "trials"))
    run = partial(
        search.search_model, df, model, store=store, layout=layout, fixed=SEARCH_FIXED.get(model), space=SEARCH_SPACES[model]
    )
    run(n_trials=2)
    names = F.array(*[F.lit(d.name) for d in SEARCH_SPACES[model]])
    return run(n_trials=1).select("trial", "state", "params", F.explode(names).alias("param")).select(
        "trial", "state", "param", F.round(F.col("params")[F.col("param")].cast("double"), 9).alias("value")
    )


# ------------------------------------------------------- stacking, ensembling


def meta_features(spark, sf):
    rows = fx.campaign(spark, sf)
    out = ensemble.meta_features(
        fx.preds(spark, sf), ["m3", "m1"], labels=rows.where("split = 'train'"),
        features=rows.select("id", "split", "segment", "qty"),
    )
    return out


def meta_features_bucketed(spark, sf):
    """The same rows from feature, prediction and label tables bucketed by id."""
    rows = fx.campaign(spark, sf)
    store = bucketed.BucketedStore(spark, fresh_path(spark, "bucketed"), buckets=8)
    store.save(rows.select("id", "split", "segment", "qty"), "features")
    store.save(rows.where("split = 'train'").select("id", "target"), "labels")
    bucketed.save_predictions(store, fx.preds(spark, sf), ["m3", "m1"])
    return bucketed.meta_features(store, ["m3", "m1"], "features", "labels")


def meta_features_scaled(spark, sf):
    out = ensemble.meta_features(fx.preds(spark, sf), ["m1", "m2"], scale=True)
    return fq.rounded(out, ["pred_m1", "pred_m2"])


def meta_features_multiclass(spark, sf):
    """One model with three classes, one with two (class 1 is kept)."""
    rows = fx.preds_multi(spark, sf)
    three = rows.select(F.lit("a").alias("model_id"), "id", "split", F.array("p0", "p1", "p2").alias("pred"))
    two = rows.select(F.lit("b").alias("model_id"), "id", "split", F.array(1 - F.col("p0"), "p0").alias("pred"))
    wide = ensemble.meta_features(three, ["a"], classes=3)
    return wide.join(ensemble.meta_features(two, ["b"]).drop("split"), "id")


WEIGHTS = {"m1": 0.5, "m2": 1.5, "m3": 1.0}


def weighted_blend(spark, sf):
    test = fx.preds(spark, sf).where("split = 'test'")
    blend = ensemble.weighted_blend(test, WEIGHTS)
    store = stores.PredictionStore(spark, fresh_path(spark, "preds"))
    store.save(blend, "ens", "e1", "ens")
    return store.load("ens", ["e1"], "ens").select("id", F.round("pred", 9).alias("pred"))


TRIALS = 500


def ensemble_weight_search(spark, sf):
    ids = ["m1", "m2", "m3"]
    train = fx.preds(spark, sf).where("split = 'train'")
    labels = fx.campaign(spark, sf).select("id", F.col("target_planted").alias("target"))
    drawn = ensemble.weight_candidates(spark.range(TRIALS).select(F.col("id").alias("trial")), ids)
    out = ensemble.search_weights(train, labels, ids, drawn, top_k=10)
    return out.select("trial", F.round("auc", 9).alias("auc"))


QUERIES = {f"oof_{m}": partial(oof, m) for m in QUICK}
QUERIES |= {f"one_fold_{m}": partial(one_fold, m) for m in QUICK}
QUERIES |= {f"stump_{m}": partial(stump, m) for m in STUMPS}
QUERIES |= {f"search_{m}": partial(search_model, m) for m in QUICK}
QUERIES |= {
    f.__name__: f
    for f in (
        oof_logreg_multiclass, one_fold_logreg_multiclass, oof_ridge_univariate, ridge_univariate, logreg_saturated, full_train, model_roundtrip,
        gain_importance, permutation_importance, fold_average, cv_summary, best_fold, early_stop_pick,
        candidate_table, candidate_grid, param_influence_rank, topk_trials, topk_trials_loss, trial_history, param_influence, meta_features, meta_features_bucketed,
        meta_features_scaled, meta_features_multiclass, weighted_blend, ensemble_weight_search,
    )
}

C = fx.CAMPAIGN


def uniform_sql(seed, trial, name):
    return f"(cast('0x' || substr(md5('{seed}_' || cast({trial} as varchar) || '_{name}'), 1, 13) as bigint) / 4503599627370496.0)"


def _u(name):
    return uniform_sql(42, "trial", name)


def _drawn_sql(dim):
    """The draw of a parameter in SQL, from its range."""
    u = _u(dim.name)
    if dim.kind == "int":
        step = dim.step or 1
        return f"cast({dim.low} + floor({u} * {(dim.high - dim.low) // step + 1}) * {step} as double)"
    if dim.log:
        return f"exp(ln({dim.low}) + {u} * (ln({dim.high}) - ln({dim.low})))"
    return f"{dim.low} + {u} * ({dim.high} - {dim.low})"


def _search_sql(model):
    parts = [
        f"select trial, 'complete' as state, '{d.name}' as param, round({_drawn_sql(d)}, 9) as value from t" for d in SEARCH_SPACES[model]
    ]
    return "with t as (select cast(unnest(range(0, 3)) as bigint) as trial) " + " union all ".join(parts)


_SUMS = """n, sx, sy, (sxy - sx*sy/n) / (sxx - sx*sx/n + 500.0) as w"""
_RIDGE = f"""{C}, d as (select id, balance/1000 as x, price/100000 as y,
      cast((row_number() over (order by md5('42_'||cast(id as varchar)), id)-1) % 5 as int) as fold
    from campaign where split='train')"""

_PLAIN = "cast((row_number() over (order by md5('42_'||cast(id as varchar)), id)-1) % 5 as int)"
_STRATIFIED = "cast((row_number() over (partition by {y} order by md5('42_'||cast(id as varchar)), id)-1) % 5 as int)"


def _folded_sql(model):
    rule = _STRATIFIED.format(y="target_planted") if models.LEARNERS[model].classifier else _PLAIN
    return f"with {C}, folded as (select id, {rule} as fold from campaign where split = 'train')"


def _oof_sql(model):
    return f"""{_folded_sql(model)} select id, 'oof' as part, fold, true as sound from folded
        union all select id, 'test', null, true from campaign where split = 'test'"""


def _one_fold_sql(model):
    return f"""{_folded_sql(model)} select '{model}' as model, '{models.LEARNERS[model].metric}' as metric, count(*) as rows,
        true as no_worse_than_constant, true as round_was_run from folded where fold = 0"""


def _stump_sql(model):
    """The split with the largest gain per left-out fold; leaf means, for boosting as half the log-odds."""
    feature, _ = STUMPS[model]
    classifier = models.LEARNERS[model].classifier
    rule = _STRATIFIED.format(y="target_planted") if classifier else _PLAIN
    label = "cast(target_planted as double)" if classifier else "(price + 20*balance)/100000"
    leaf = "1/(1+exp(-2*(2*({mean})-1)))" if models.LEARNERS[model].boosted else "{mean}"
    numeric, x = feature != "segment", "cast(floor(price/50000) as bigint)" if feature == "step" else feature
    order, left = ("x", "f.x <= b.x") if numeric else ("sy/n, x", "o2.x is not null")
    return f"""with {C}, f as (select id, case when split='train' then {rule.replace('over (', 'over (partition by split, ' if not classifier else 'over (').replace('partition by target_planted', 'partition by split, target_planted')} end as fold,
          {x} as x, {label} as y from campaign),
        k as (select distinct fold as k from f where fold is not null),
        s as (select k, x, count(*) n, sum(y) sy from k join f on f.fold <> k.k group by k, x),
        o as (select k, x, row_number() over w as pos, sum(n) over w as cn, sum(sy) over w as cs, sum(n) over (partition by k) tn,
          sum(sy) over (partition by k) ts from s window w as (partition by k order by {order})),
        b as (select * from o where cn < tn qualify row_number() over (partition by k
          order by round(cs*cs/cn + (ts-cs)*(ts-cs)/(tn-cn), 9) desc, pos) = 1),
        o2 as (select o.k, o.x from o join b on o.k = b.k and o.pos <= b.pos)
        select f.id, f.fold, round(avg(case when {left} then {leaf.format(mean='b.cs/b.cn')} else {leaf.format(mean='(b.ts-b.cs)/(b.tn-b.cn)')} end), 9) as pred
        from f join b on f.fold is null or b.k = f.fold left join o2 on o2.k = b.k and o2.x = f.x group by f.id, f.fold"""


SQL = {f"oof_{m}": _oof_sql(m) for m in QUICK} | {f"one_fold_{m}": _one_fold_sql(m) for m in QUICK}
_FEATURES = "count(*) as features, 'price' as first"
_NAMES = f"(select unnest({fx.CAMPAIGN_FEATURES}) as name)"
SQL["gain_importance"] = f"select {_FEATURES}, true as adds_up from {_NAMES}"
SQL["permutation_importance"] = f"select {_FEATURES} from {_NAMES}"
SQL["full_train"] = f"with {C} select 'gbt' as model_id, id, true as sound from campaign where split = 'test'"
SQL["oof_logreg_multiclass"] = f"""with d as (select vec_id as id, label as y from embeddings where vec_id % 5 <> 0)
    select id, {_STRATIFIED.format(y='y')} as fold, cast(10 as int) as classes, true as sound from d"""
SQL["one_fold_logreg_multiclass"] = """select true as same_as_whole_run, count(distinct vec_id % 5) as folds, true as summary_within_folds
    from embeddings"""
SQL |= {f"stump_{m}": _stump_sql(m) for m in STUMPS}
SQL["logreg_saturated"] = f"""{_folded_sql('logreg').replace('select id,', 'select id, returned, target_planted as y,')},
    g as (select returned, fold, count(*) n, sum(y) s from folded group by all), t as (select returned, sum(n) n, sum(s) s from g group by all)
    select id, fold, round((t.s - g.s) / (t.n - g.n), 6) as pred from folded join g using (returned, fold) join t using (returned)"""
SQL |= {f"search_{m}": _search_sql(m) for m in SEARCH_SPACES}
SQL |= {
    "oof_ridge_univariate": f"""with {_RIDGE}, k as (select distinct fold f from d),
        s as (select f, count(*) n, sum(x) sx, sum(y) sy, sum(x*y) sxy, sum(x*x) sxx from k join d on d.fold<>k.f group by f),
        m as (select f, {_SUMS} from s)
        select id, fold, round(sy/n + w*(x - sx/n), 6) as pred from d join m on m.f=d.fold""",
    "ridge_univariate": f"""with {_RIDGE},
        s as (select count(*) n, sum(x) sx, sum(y) sy, sum(x*y) sxy, sum(x*x) sxx from d), m as (select {_SUMS} from s)
        select round(w, 8) as weight, round(sy/n - w*sx/n, 8) as intercept from m""",
    "model_roundtrip": f"""with {C} select split, count(*) as n_rows, cast(0 as bigint) as n_changed
        from campaign group by split""",
    "fold_average": f"""with {fx.PREDS} select id, round((max(case when model_id='m1' then pred end)
        + max(case when model_id='m2' then pred end) + max(case when model_id='m3' then pred end))/3, 9) as pred
        from preds where split='test' group by id""",
    "cv_summary": f"""with {sq.SCORED}, f as ({sq.auc_sql('p', 'target', by='fold')}), a as ({sq.auc_sql('p', 'target')})
        select cast(count(*) as bigint) as folds, round(avg(f.value),9) as mean, round(stddev_pop(f.value),9) as std,
        round(max(a.value),9) as oof_score from f cross join a""",
    "best_fold": f"""with {sq.SCORED}, f as (select 'auc' metric, fold, value, -value as loss
          from ({sq.auc_sql('p', 'target', by='fold')})
          union all select 'logloss', fold, {sq.LOGLOSS}, {sq.LOGLOSS} from scored group by fold
          union all select 'rmse', fold, {sq.RMSE}, {sq.RMSE} from scored group by fold)
        select metric, fold, round(value,6) as value from f
        qualify row_number() over (partition by metric order by loss, fold) = 1""",
    "early_stop_pick": """with c as (select l_returnflag||l_linestatus as model, dayofyear(l_shipdate) as it,
          round(avg(l_discount),9) as loss from lineitem group by 1, 2),
        r as (select *, row_number() over (partition by model order by it) rn from c),
        b as (select a.model, a.it, a.loss, a.rn from r a where not exists
          (select 1 from r e where e.model=a.model and e.rn<a.rn and e.loss<=a.loss)),
        k as (select * from b where not exists
          (select 1 from b n where n.model=b.model and n.rn>b.rn and n.rn<=b.rn+10))
        select model, cast(it as int) as best_iteration, loss as best_loss from k
        qualify row_number() over (partition by model order by rn) = 1""",
    "candidate_table": f"""with {fx.TRIALS}, a as (select trial,
          0.01 + {_u('rate')}*(0.3-0.01) as rate, exp(ln(1e-4) + {_u('penalty')}*(ln(40.0)-ln(1e-4))) as penalty,
          cast(3 + floor({_u('depth')}*28) as bigint) as depth,
          cast(256 + floor({_u('width')}*25)*32 as bigint) as width,
          {_u('width2')} as u2, 0.1 + floor({_u('dropout')}*7)*0.05 as dropout,
          ['ReLU','LeakyReLU','GELU','SiLU'][1 + cast(floor({_u('activation')}*4) as int)] as activation from trials)
        select trial, round(rate,9) as rate, round(penalty,9) as penalty, depth, width,
          cast(128 + floor(u2*(floor((width-128)/32)+1))*32 as bigint) as width2, round(dropout,9) as dropout,
          activation, greatest(depth, cast(floor(log2(width)) as bigint)+1) as min_depth from a""",
    "candidate_grid": f"""with {fx.TRIALS}, g as (select trial*7 as trial from trials),
        d as (select trial, trial % 4 as a, (trial // 4) % 7 as dr, (trial // 28) % 28 as de, (trial // 784) % 4 as pe, (trial // 3136) % 4 as ra
          from g where trial < 4*4*28*7*4)
        select trial, round(0.01 + ra/3.0*(0.3-0.01), 9) as rate, round(1e-4*pow(40.0/1e-4, pe/3.0), 9) as penalty,
          cast(3 + de as bigint) as depth, round(0.1 + cast(dr as double)*0.05, 9) as dropout, ['ReLU','LeakyReLU','GELU','SiLU'][1 + a] as activation from d""",
    "param_influence_rank": f"""with {fx.TRIALS}, s as (select max_depth, trial, value from trials where value is not null),
        r as (select rank() over (order by max_depth) + (count(*) over (partition by max_depth) - 1)/2.0 as rm,
          rank() over (order by trial) + (count(*) over (partition by trial) - 1)/2.0 as rt,
          rank() over (order by value) + (count(*) over (partition by value) - 1)/2.0 as rv from s)
        select 'max_depth' as param, round(abs(corr(rm, rv)), 8) as influence from r
        union all select 'trial', round(abs(corr(rt, rv)), 8) from r""",
    "topk_trials": f"""with {fx.TRIALS} select * from trials where value is not null
        order by value desc, trial limit 10""",
    "topk_trials_loss": f"""with {fx.TRIALS} select * from trials where value is not null
        order by value, trial limit 10""",
    "trial_history": f"""with {fx.TRIALS} select study, trial, value,
        max(value) over (partition by study order by trial) as best_max,
        min(value) over (partition by study order by trial) as best_min from trials""",
    "param_influence": f"""with {fx.TRIALS}, s as (select * from trials where value is not null),
        g as (select activation, count(*) n, avg(value) m from s group by activation)
        select 'max_depth' as param, round(abs(corr(max_depth, value)),8) as influence from s
        union all select 'trial', round(abs(corr(trial, value)),8) from s
        union all select 'activation', round(sqrt(sum(n*(m-t)*(m-t))/max(sst)),8) from g
          cross join (select avg(value) t, var_pop(value)*count(*) sst from s)""",
    "meta_features": f"""with {fx.PREDS} select c.id, c.split, max(case when model_id='m3' then pred end) as pred_m3,
        max(case when model_id='m1' then pred end) as pred_m1, max(segment) as segment, max(qty) as qty,
        max(case when c.split='train' then target end) as target
        from campaign c join preds p on p.id=c.id group by c.id, c.split""",
    "meta_features_bucketed": f"""with {C} select id, split, segment, qty, qty/500 as pred_m3, price/500000 as pred_m1,
        case when split='train' then target end as target from campaign""",
    "meta_features_scaled": f"""with {C}, w as (select id, split, price/500000 as pred_m1, (balance+1000)/11000 as pred_m2 from campaign)
        select id, split, """
    + ", ".join(
        f"round((pred_{m} - (select avg(pred_{m}) from w where split='train'))/(select stddev_pop(pred_{m}) from w where split='train'),6) as pred_{m}"
        for m in ("m1", "m2")
    )
    + " from w",
    "meta_features_multiclass": f"""with {fx.PREDS_MULTI} select id, split, p0 as pred_a_0, p1 as pred_a_1,
        p2 as pred_a_2, p0 as pred_b from preds_multi""",
    "weighted_blend": f"""with {C} select id, round((0.5*price/500000 + 1.5*(balance+1000)/11000 + qty/500)/3, 9) as pred
        from campaign where split='test'""",
    "ensemble_weight_search": f"""with {C}, r as (select cast(unnest(range(0,{TRIALS})) as bigint) trial),
        a as (select trial, {uniform_sql(42, 'trial', 'raw_w0')} a0, {uniform_sql(42, 'trial', 'raw_w1')} a1,
          {uniform_sql(42, 'trial', 'raw_w2')} a2 from r),
        s as (select trial, target_planted y, a0/(a0+a1+a2)*(price/500000) + a1/(a0+a1+a2)*((balance+1000)/11000)
          + a2/(a0+a1+a2)*(qty/500) sc from a cross join campaign where split='train')
        select trial, round(value,9) as auc from ({sq.auc_sql('sc', 'y', view='s', by='trial')})
        order by value desc, trial limit 10""",
}
