"""Boosted models round by round: margins after each tree, their scores, and models cut to their first trees.

The trees of a fitted model are applied side by side in one projection, so a row's running margins are one
array and a single job scores every round of every fold, by the learner's own metric. The trees of a block
of rounds go into a projection; what came before them is one margin of the cut model.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions import metrics
from rowloom.layout import DEFAULT, Layout
from rowloom.operators.columns import col
from rowloom.session import settle

#: rounds that one job scores
BLOCK = 64


def truncated(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model of the first ``rounds`` trees; nothing is fitted."""
    if not 1 <= rounds <= model.getNumTrees:
        raise ValueError(f"a model of {model.getNumTrees} trees has no first {rounds}")
    java, gateway = model._java_obj, SparkContext._active_spark_context._gateway
    tree = gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    trees, weights = gateway.new_array(tree, rounds), gateway.new_array(gateway.jvm.double, rounds)
    for i in range(rounds):
        trees[i], weights[i] = java.trees()[i], java.treeWeights()[i]
    cut = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        java.uid(), trees, weights, java.numFeatures(), java.numClasses()
    )
    out = GBTClassificationModel(cut)
    return out.setFeaturesCol(model.getFeaturesCol())


def with_margins(
    model: GBTClassificationModel, rows: DataFrame, first: int = 1, last: int | None = None, out: str = "margins"
) -> DataFrame:
    """``rows`` with the running margins after rounds ``first`` to ``last`` as an array column."""
    last = last or model.getNumTrees
    base, kept = F.lit(0.0), rows.columns
    if first > 1:
        before = truncated(model, first - 1).setRawPredictionCol("_raw").setProbabilityCol("").setPredictionCol("")
        rows = before.transform(rows)
        base = F.get(vector_to_array("_raw"), F.lit(1))
    steps, weights = [], model.treeWeights
    for i, tree in enumerate(model.trees[first - 1 : last]):
        name = f"_tree{i}"
        rows = tree.setFeaturesCol(model.getFeaturesCol()).setPredictionCol(name).transform(rows)
        steps.append(F.col(name) * F.lit(weights[first - 1 + i]))
    running = F.aggregate(
        F.array(*steps), F.array(base),
        lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)),
    )
    return rows.select(*[col(c) for c in kept], F.slice(running, 2, len(steps)).alias(out))


def round_scores(
    models: Mapping[int, GBTClassificationModel], rows: DataFrame, metric: str, layout: Layout = DEFAULT,
    first: int = 1, last: int | None = None,
) -> DataFrame:
    """(fold, iteration, value): the score of each fold's model on its left-out rows after every round, in one job."""
    parts = None
    for f, model in models.items():
        end = min(last or model.getNumTrees, model.getNumTrees)
        if end < first:
            continue
        own = rows.where(col(layout.fold) == f).select(layout.fold, layout.label, model.getFeaturesCol())
        own = with_margins(model, own, first, end).select(
            col(layout.fold).alias("fold"), col(layout.label).alias("_label"), F.posexplode("margins").alias("_at", "_margin")
        )
        parts = own if parts is None else parts.unionByName(own)
    # equal margins are one row; written, since a score reads them more than once and each reading would run all trees
    counted = settle(parts.groupBy("fold", "_at", "_margin", "_label").agg(F.count(F.lit(1)).alias("_n")), "margins")
    scored = counted.select(
        "fold", (F.col("_at") + first).alias("iteration"), (1 / (1 + F.exp(-2 * F.col("_margin")))).alias("_p"), "_label", "_n"
    )
    if metric == "auc":
        return metrics.auc(scored, "_p", "_label", ["fold", "iteration"], "value", count="_n")
    loss = {"logloss": metrics.log_loss, "accuracy": lambda p, y: metrics.accuracy((p >= 0.5).cast("int"), y)}[metric]
    repeated = scored.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_")
    return repeated.groupBy("fold", "iteration").agg(loss(F.col("_p"), F.col("_label")).alias("value"))


def best_rounds(
    models: Mapping[int, GBTClassificationModel], rows: DataFrame, metric: str, patience: int, layout: Layout = DEFAULT, block: int = BLOCK
) -> tuple[dict[int, int], DataFrame]:
    """The round that early stopping keeps for each fold, and the curves (fold, iteration, value) it was read off.

    The kept round is the first that no later one within ``patience`` rounds beats. Rounds are scored in
    blocks, and only for folds that have not stopped yet. A score that is undefined (one class) beats nothing.
    """
    from rowloom.plans.cv import first_best

    spark, sign = rows.sparkSession, -1 if metrics.HIGHER_IS_BETTER[metric] else 1
    curves: dict[int, list[float]] = {f: [] for f in models}
    best: dict[int, int] = {}
    first = 1
    while len(best) < len(models):
        open_ = {f: m for f, m in models.items() if f not in best}
        table = round_scores(open_, rows, metric, layout, first, first + block - 1)
        # as many rows as rounds and folds
        found = {(r["fold"], r["iteration"]): r["value"] for r in table.collect()}
        for f, model in open_.items():
            end = min(first + block - 1, model.getNumTrees)
            values = (found.get((f, i)) for i in range(first, end + 1))
            curves[f] += [float("inf") if v is None else sign * v for v in values]
            kept = first_best(curves[f], patience)
            if end == model.getNumTrees or kept + patience < len(curves[f]):
                best[f] = kept + 1
        first += block
    points = [(f, i + 1, None if v == float("inf") else sign * v) for f, c in curves.items() for i, v in enumerate(c)]
    return best, spark.createDataFrame(points, "fold int, iteration int, value double")
