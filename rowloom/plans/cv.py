"""Cross-validated training, out-of-fold predictions and what is read off them."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions import metrics
from rowloom.layout import DEFAULT, TEST, TRAIN, Layout
from rowloom.operators.columns import col, q
from rowloom.plans import descent, epochs, staged
from rowloom.plans.models import LEARNERS, Learner, Prepared, TrainStats, prepare
from rowloom.session import shared_dir


def _in_threads(spark, work, items: Sequence, parallelism: int) -> list:
    """Run driver-side loops that each start their own Spark jobs next to each other."""
    if parallelism <= 1 or len(items) <= 1:
        return [work(i) for i in items]
    with ThreadPool(min(parallelism, len(items))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), items)


def _learner(model: str | Learner) -> Learner:
    return LEARNERS[model] if isinstance(model, str) else model


def _train_rows(p: Prepared, layout: Layout) -> DataFrame:
    return p.data.where(col(layout.split) == TRAIN)


def fold_stats(p: Prepared, layout: Layout) -> dict[int | None, TrainStats]:
    """Train facts per left-out fold, and for no fold left out, from one aggregation; further calls reuse them."""
    if p.facts is None:
        p.facts = _fold_stats(p, layout)
    return p.facts


def _fold_stats(p: Prepared, layout: Layout) -> dict[int | None, TrainStats]:
    rows = (
        _train_rows(p, layout).groupBy(layout.fold)
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum(layout.label).alias("s"),
            F.avg(layout.label).alias("m"), F.var_pop(layout.label).alias("v"),
            F.max(layout.label).alias("top"),
        )
        .collect()
    )
    classes = int(max((r["top"] or 0) for r in rows)) + 1 if rows else 2

    def merged(parts):
        n = sum(r["n"] for r in parts)
        if not n:
            return TrainStats(0, 0.0, len(p.names), classes, p.most_levels)
        mean = sum(r["s"] for r in parts) / n
        spread = sum(r["n"] * (r["v"] + (r["m"] - mean) ** 2) for r in parts) / n
        return TrainStats(n, math.sqrt(spread), len(p.names), max(classes, 2), p.most_levels)

    folds = sorted(r[layout.fold] for r in rows if r[layout.fold] is not None)
    out = {f: merged([r for r in rows if r[layout.fold] != f]) for f in folds}
    out[None] = merged(rows)
    return out


def scores_by(
    df: DataFrame, learner: Learner, classes: int, label: str, by: Sequence[str] = (), pred: str = "pred"
) -> DataFrame:
    """The learner's metric as ``value``, per group; class probabilities are an array for three classes or more."""
    if learner.classifier and classes > 2:
        value = metrics.multi_log_loss([F.get(pred, F.lit(i)) for i in range(classes)], col(label))
        return df.groupBy(*[col(b) for b in by]).agg(value.alias("value"))
    return metrics.score_table(df, learner.metric, pred, label, by)


def _checkpoints(spark) -> None:
    """Boosting cuts its lineage in the checkpoint folder every few rounds."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def _fit(learner, params, stats, rows, layout, seed):
    _checkpoints(rows.sparkSession)
    estimator = learner.estimator(params, stats, seed).setLabelCol(layout.label)
    if learner.weighted and layout.weight in rows.columns:
        estimator = estimator.setWeightCol(layout.weight)
    if learner.name == "mlp" and estimator.getSolver() == "gd":
        return descent.fit(estimator, rows)
    return estimator.fit(rows)


def first_best(losses: Sequence[float], patience: int) -> int:
    """0-based round kept by early stopping: the best one before ``patience`` rounds without gain."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best


def _rounds(learner: Learner, params: Mapping | None) -> int | None:
    return int(learner.resolve(params)["rounds"]) if learner.boosted else None


@dataclass
class CvResult:
    """Everything a cross-validated fit yields."""

    learner: Learner
    oof: DataFrame  # id, fold, label, pred
    test: DataFrame  # id, pred (average over fold models)
    scores: DataFrame  # fold, value, best_iteration
    models: dict[int, object]
    prepared: Prepared
    classes: int = 2
    curves: DataFrame | None = None  # fold, iteration, value; with early stopping

    def pipeline(self, fold: int) -> PipelineModel:
        """A fold's model together with the step that builds its feature vector."""
        return PipelineModel(stages=[self.prepared.assembler, self.models[fold]])

    def summary(self) -> DataFrame:
        return cv_summary(self.scores, self.oof, self.learner.metric, classes=self.classes)

    def release(self) -> None:
        """Drop the cached model input; predictions read later are computed anew."""
        self.prepared.release()


def cross_validate(
    df: DataFrame, model: str | Learner, params: Mapping | None = None, layout: Layout = DEFAULT,
    seed: int = 42, patience: int | None = None, parallelism: int = 5,
) -> CvResult:
    """Fit one model per fold; predict the left-out rows, and test rows by all models.

    Folds are independent, so some are fitted at the same time. Test rows pass
    through all models in one scan; nothing is joined. With ``patience``, boosted models are
    cut to the round with the best score on the left-out rows, by the learner's metric; one job
    scores the rounds of all folds, and no model is fitted twice. Perceptrons are kept at their best step of epochs.
    """
    learner = _learner(model)
    spark = df.sparkSession
    p = prepare(df, learner, layout)
    stats = fold_stats(p, layout)
    folds = [f for f in stats if f is not None]
    classes = stats[None].classes if learner.classifier else 2
    train, fold = _train_rows(p, layout), col(layout.fold)

    by_epochs = learner.name == "mlp" and patience is not None

    def one(f):
        own = train.where(fold != f)
        if by_epochs:
            return epochs.fit_by_epochs(learner, params, stats[f], own, train.where(fold == f), layout, seed, patience)
        return _fit(learner, params, stats[f], own, layout, seed)

    models = dict(zip(folds, _in_threads(spark, one, folds, parallelism)))
    kept, curves = dict.fromkeys(folds, _rounds(learner, params)), None
    if by_epochs:
        for f, m in models.items():
            own = m.curve.select(F.lit(f).alias("fold"), F.col("epoch").alias("iteration"), "value")
            curves = own if curves is None else curves.unionByName(own)
        kept, models = {f: m.best_epoch for f, m in models.items()}, {f: m.model for f, m in models.items()}
    if learner.boosted and patience is not None:
        kept, curves = staged.best_rounds(models, train, learner.metric, patience, layout)
        models = {f: staged.truncated(m, kept[f]) for f, m in models.items()}
    fitted = {f: (m, kept[f]) for f, m in models.items()}
    oof = None
    for f, (fit, _) in fitted.items():
        part = fit.transform(train.where(fold == f)).select(
            layout.id, layout.fold, layout.label, learner.score_column(fit, classes).alias("pred")
        )
        oof = part if oof is None else oof.unionByName(part)
    test = p.data.where(col(layout.split) == TEST).select(layout.id, "features")
    for f, (fit, _) in fitted.items():
        scored = fit.transform(test)
        test = scored.select(
            *[q(c) for c in test.columns], learner.score_column(fit, classes).alias(f"_pred{f}")
        )
    preds = [F.col(f"_pred{f}") for f in folds]
    test = test.select(layout.id, fold_average(preds, classes if learner.classifier else 2).alias("pred"))
    scores = scores_by(oof, learner, classes, layout.label, [layout.fold])
    rounds = spark.createDataFrame(
        [(f, best) for f, (_, best) in fitted.items()], f"{layout.fold} int, best_iteration int"
    )
    scores = scores.join(F.broadcast(rounds), layout.fold)
    return CvResult(learner, oof, test, scores, models, p, classes, curves)


def fold_average(preds: Sequence, classes: int = 2):
    """Plain average of the fold models' predictions, entry by entry for class arrays."""
    if classes == 2:
        return sum(preds[1:], preds[0]) / len(preds)
    return F.array(
        *[sum((F.get(p, F.lit(i)) for p in preds[1:]), F.get(preds[0], F.lit(i))) / len(preds)
          for i in range(classes)]
    )


def fit_one_fold(
    df: DataFrame, model: str | Learner, params: Mapping | None = None, fold: int = 0,
    layout: Layout = DEFAULT, seed: int = 42, patience: int | None = None,
    prepared: Prepared | None = None,
) -> tuple[object, float | None, int | None]:
    """Model, score and best round of a single fold (for parameter search)."""
    learner = _learner(model)
    p = prepared or prepare(df, learner, layout)
    found = fold_stats(p, layout)
    stats, classes = found[fold], found[None].classes if learner.classifier else 2
    rows = _train_rows(p, layout)
    train, valid = rows.where(col(layout.fold) != fold), rows.where(col(layout.fold) == fold)
    if learner.name == "mlp" and patience is not None:
        stopped = epochs.fit_by_epochs(learner, params, stats, train, valid, layout, seed, patience)
        if prepared is None:
            p.release()
        return stopped.model, stopped.value, stopped.best_epoch
    fit, best = _fit(learner, params, stats, train, layout, seed), _rounds(learner, params)
    if learner.boosted and patience is not None:
        best = staged.best_rounds({fold: fit}, valid, learner.metric, patience, layout)[0][fold]
        fit = staged.truncated(fit, best)
    if learner.name == "mlp":
        # Spark scores a row at a time, by matrix and vector
        pred = descent.probabilities(fit)
        scored = valid.select(layout.label, (F.get(pred, F.lit(1)) if classes == 2 else pred).alias("pred"))
    else:
        scored = fit.transform(valid).select(layout.label, learner.score_column(fit, classes).alias("pred"))
    value = scores_by(scored, learner, classes, layout.label).first()
    if prepared is None:
        p.release()
    return fit, value["value"] if value else None, best


def full_train(
    df: DataFrame, model: str | Learner, iterations: float | None = None,
    params: Mapping | None = None, layout: Layout = DEFAULT, seed: int = 42,
) -> DataFrame:
    """Test predictions of one model fitted on all train rows.

    Boosted models run a quarter longer than ``iterations``, the average best round
    of the folds, since they see more rows.
    """
    learner = _learner(model)
    params = learner.resolve(params)
    if learner.boosted and iterations is not None:
        params["rounds"] = int(iterations * 1.25)
    p = prepare(df, learner, layout)
    stats = fold_stats(p, layout)[None]
    fit = _fit(learner, params, stats, _train_rows(p, layout), layout, seed)
    test = p.data.where(col(layout.split) == TEST)
    classes = stats.classes if learner.classifier else 2
    return fit.transform(test).select(layout.id, learner.score_column(fit, classes).alias("pred"))


def cv_summary(
    scores: DataFrame, oof: DataFrame, metric: str, layout: Layout = DEFAULT, value: str = "pred", classes: int = 2
) -> DataFrame:
    """Mean and population deviation of the fold scores, and the score of all rows together.

    With three classes or more ``value`` is an array of probabilities and the score the log-loss.
    """
    folds = scores.agg(
        F.count("value").alias("folds"), F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        *([F.avg("best_iteration").alias("avg_best_iteration")] if "best_iteration" in scores.columns else []),
    )
    if classes > 2:
        loss = metrics.multi_log_loss([F.get(value, F.lit(i)) for i in range(classes)], col(layout.label))
        whole = oof.agg(loss.alias("value")).first()
    else:
        whole = metrics.score_table(oof, metric, value, layout.label).first()
    return folds.withColumn("oof_score", F.lit(whole["value"] if whole else None).cast("double"))


def best_fold(scores: DataFrame, metric: str, layout: Layout = DEFAULT) -> DataFrame:
    """The fold with the best score, whichever direction is better for the metric."""
    value = F.col("value")
    order = value.desc_nulls_last() if metrics.HIGHER_IS_BETTER[metric] else value.asc_nulls_last()
    return scores.orderBy(order, layout.fold).limit(1)


def early_stop_pick(
    losses: DataFrame, by: Sequence[str], iteration: str, loss: str, patience: int
) -> DataFrame:
    """The round early stopping keeps, per loss curve.

    The kept round is the first one that beats all before it and is not beaten within
    ``patience`` further rounds. A curve has as many rows as rounds were run.
    """
    run = Window.partitionBy(*by).orderBy(iteration)
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    at, value = col(iteration), col(loss)
    gains = (
        losses.withColumn("_round", F.row_number().over(run))
        .withColumn("_best", F.min(value).over(before))
        .where("_best is null or " + q(loss) + " < _best")
        .withColumn("_next", F.lead("_round").over(run))
        .where(F.col("_next").isNull() | (F.col("_next") - F.col("_round") > patience))
    )
    return gains.groupBy(*by).agg(
        F.min_by(at, F.col("_round")).alias("best_iteration"),
        F.min_by(value, F.col("_round")).alias("best_loss"),
    )


def gain_importance(model, names: Sequence[str], spark) -> DataFrame:
    """Share of the total gain per feature in percent, largest first."""
    values = [float(v) for v in model.featureImportances.toArray()]
    total = sum(values) or 1.0
    rows = [(n, round(100.0 * v / total, 2)) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )
