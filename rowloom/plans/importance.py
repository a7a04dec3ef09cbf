"""Permutation importance, from the features that a model really uses.

A tree that has no split on a feature says the same whatever that feature holds. So features that no tree uses are
worth zero without scoring, and for each other one only the trees that split on it are applied again; the others'
values are read from the row's array of tree values. Rows are never multiplied: shuffled scores are columns, taken
in blocks, and only (feature, score, label) counts leave a block.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions import metrics
from rowloom.layout import DEFAULT, Layout
from rowloom.operators.columns import col
from rowloom.operators.ordering import shuffled_rank
from rowloom.plans.cv import scores_by
from rowloom.plans.models import Learner, Prepared
from rowloom.session import settle

#: trees that one projection applies, or models if they are no trees
BLOCK = 64


def features_by_tree(model) -> list[set[int]] | None:
    """The features that each tree of an ensemble splits on; None for models without trees."""
    if not hasattr(model, "trees"):
        return None
    return [{i for i, v in enumerate(t.featureImportances.toArray()) if v > 0} for t in model.trees]


def _tree_value(tree, learner: Learner, rows: DataFrame, features: str, out: str) -> DataFrame:
    """``rows`` with what a tree says on a vector column: its class-1 probability or its value."""
    kept = [col(c) for c in rows.columns]
    tree = tree.setFeaturesCol(features).setPredictionCol("_value")
    if learner.classifier and not learner.boosted:
        said = tree.setProbabilityCol("_share").setRawPredictionCol("").transform(rows)
        return said.select(*kept, F.get(vector_to_array("_share"), F.lit(1)).alias(out))
    return tree.transform(rows).select(*kept, F.col("_value").alias(out))


def _combined(model, learner: Learner, values: list[Column]) -> Column:
    """The ensemble's score from its trees' values, always added in the order of the trees."""
    total = F.lit(0.0)
    weights = model.treeWeights if learner.boosted else [1.0 / len(values)] * len(values)
    for value, weight in zip(values, weights):
        total = total + value * F.lit(float(weight))
    return 1 / (1 + F.exp(-2 * total)) if learner.boosted else total


def _swapped(feature: int, used: list[int]) -> Column:
    """The row's vector with one feature of its partner."""
    other = F.get("_other", F.lit(used.index(feature)))
    return array_to_vector(F.transform("_own", lambda x, i: F.when(i == feature, other).otherwise(x)))


def _blocks(work: list[tuple[int, int]], size: int):
    """Features in blocks whose work adds up to ``size``, or one alone."""
    block, held = [], 0
    for feature, load in work:
        if block and held + load > size:
            yield block
            block, held = [], 0
        block.append(feature)
        held += load
    if block:
        yield block


def _block_scores(scored: DataFrame, names: dict[int, str], learner: Learner, classes: int, label: str) -> dict[int, float]:
    """The metric of each score column. Equal scores of a label are one row from the first task on."""
    cells = F.array(*[F.struct(F.lit(i).alias("_feature"), col(c).alias("pred")) for i, c in names.items()])
    long = scored.select(col(label), F.explode(cells).alias("_cell")).select(label, "_cell.*")
    if learner.metric == "auc" and classes == 2:
        counted = settle(long.groupBy("_feature", "pred", label).agg(F.count(F.lit(1)).alias("_n")), "importance")
        found = metrics.auc(counted, "pred", label, ["_feature"], "value", count="_n")
    else:
        found = scores_by(long, learner, classes, label, ["_feature"])
    # as many numbers as the block has features
    return {r["_feature"]: r["value"] for r in found.collect()}


def permutation_importance(
    model, prepared: Prepared, learner: Learner, rows: DataFrame, layout: Layout = DEFAULT,
    seed: int = 42, classes: int = 2, block: int = BLOCK,
) -> DataFrame:
    """How much the metric falls when one feature is shuffled: (feature, drop, used), a row per feature.

    Each row meets one other row, the same for all features, by joining two random orders on their ranks; only
    features in use travel. Without rows, or where the metric is undefined, no drop is stated (NULL), except
    that a feature no tree uses is worth 0.
    """
    names, label = prepared.names, layout.label
    by_tree = features_by_tree(model) if classes == 2 or not learner.classifier else None
    used = list(range(len(names))) if by_tree is None else sorted(set().union(*by_tree))
    found: dict[int, float] = {}
    if used:
        vector = vector_to_array("features")
        base = rows.select(layout.id, label, "features")
        here = shuffled_rank(base, layout.id, seed, out="_rank")
        there = shuffled_rank(base.select(layout.id, F.array(*[F.get(vector, F.lit(i)) for i in used]).alias("_other")), layout.id, seed + 1, out="_rank")
        paired = here.join(there.select("_rank", "_other"), "_rank").select(col(label), "features", vector.alias("_own"), "_other")
        if by_tree is None:
            found = _by_model(model, settle(paired, "importance"), learner, used, label, classes, block)
        else:
            found = _by_trees(model, paired, learner, used, by_tree, label, block)
    sign = 1 if metrics.HIGHER_IS_BETTER[learner.metric] else -1
    whole = found.get(-1)
    drops = []
    for i, name in enumerate(names):
        known = whole is not None and found.get(i) is not None
        drops.append((name, 0.0 if i not in used else (whole - found[i]) * sign if known else None, i in used))
    return rows.sparkSession.createDataFrame(drops, "feature string, drop double, used boolean")


def _by_trees(model, paired, learner, used, by_tree, label, block) -> dict[int, float]:
    trees = model.trees
    # what every tree says of the row as it is, written once; the shuffled scores start from it
    for first in range(0, len(trees), block):
        own = paired.columns
        for t in range(first, min(first + block, len(trees))):
            paired = _tree_value(trees[t], learner, paired, "features", f"_t{t}")
        said = F.array(*[F.col(f"_t{t}") for t in range(first, min(first + block, len(trees)))])
        before = F.col("_said") if "_said" in own else F.array().cast("array<double>")
        paired = paired.select(*[c for c in own if c != "_said"], F.concat(before, said).alias("_said"))
    paired = settle(paired.drop("features"), "importance")
    whole = [F.get("_said", F.lit(t)) for t in range(len(trees))]
    found = _block_scores(paired.select(label, _combined(model, learner, whole).alias("_p")), {-1: "_p"}, learner, 2, label)
    for features in _blocks([(f, sum(f in b for b in by_tree)) for f in used], block):
        scored, names = paired, {}
        for f in features:
            scored = scored.withColumn("_swapped", _swapped(f, used))
            values = list(whole)
            for t, splits in enumerate(by_tree):
                if f in splits:
                    scored = _tree_value(trees[t], learner, scored, "_swapped", f"_f{f}_{t}")
                    values[t] = F.col(f"_f{f}_{t}")
            names[f] = f"_p{f}"
            kept = [c for c in scored.columns if c != "_swapped" and not c.startswith(f"_f{f}_")]
            scored = scored.select(*[col(c) for c in kept], _combined(model, learner, values).alias(names[f]))
        found |= _block_scores(scored, names, learner, 2, label)
    return found


def _by_model(model, paired, learner, used, label, classes, block) -> dict[int, float]:
    """Models without trees, and several classes: the whole model per feature, a column each."""
    found = {}
    for features in _blocks([(f, 1) for f in [-1, *used]], min(block, 16)):
        scored, names = paired, {}
        for f in features:
            names[f] = f"_p{f + 1}"
            vector = F.col("features") if f < 0 else _swapped(f, used)
            kept = [col(c) for c in scored.columns]
            said = model.transform(scored.withColumn("_row", F.col("features")).withColumn("features", vector))
            score = learner.score_column(model, classes).alias(names[f])
            scored = said.withColumn("features", F.col("_row")).select(*kept, score)
        found |= _block_scores(scored, names, learner, classes, label)
    return found
