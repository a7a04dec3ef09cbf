"""Learners on Spark ML: parameter names, defaults, search spaces and their mapping."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.layout import DEFAULT, Layout
from rowloom.operators.categories import LabelCodes
from rowloom.operators.columns import categorical_columns, col, numeric_columns, q

MAX_DEPTH = 30  # the deepest tree Spark ML grows
MAX_LEVELS = 512  # levels of a nominal feature that a split enumerates
BELOW_ALL = -1e30  # what trees see in place of a missing number


@dataclass(frozen=True)
class TrainStats:
    """Facts about the rows a model is fitted on."""

    rows: int
    label_deviation: float
    features: int
    classes: int = 2
    most_levels: int = 0


@dataclass(frozen=True)
class Learner:
    """A model family: how to build its estimator and how its output is scored."""

    name: str
    metric: str
    build: Callable[[dict, TrainStats, int], Estimator]
    defaults: Mapping[str, object] = field(default_factory=dict)
    classifier: bool = True
    trees: bool = False
    boosted: bool = False
    weighted: bool = True
    aliases: Mapping[str, str] = field(default_factory=dict)

    def resolve(self, params: Mapping | None) -> dict:
        """Parameters under their own names, over the defaults; unknown names are an error."""
        out = dict(self.defaults)
        for name, value in (params or {}).items():
            known = self.aliases.get(name, name)
            if known in self.defaults:
                out[known] = value
            elif name in WITHOUT_EFFECT:
                warnings.warn(f"{self.name}: {name} has no effect here", stacklevel=2)
            else:
                raise ValueError(f"{self.name} has no parameter {name!r}")
        if (out.get("max_depth") or 0) > MAX_DEPTH:
            raise ValueError(f"{self.name}: trees are at most {MAX_DEPTH} deep, not {out['max_depth']}")
        if "lr" in (params or {}) and "solver" not in (params or {}) and "solver" in out:
            # a step size only acts in gradient descent
            out["solver"] = "gd"
        return out

    def estimator(self, params: Mapping | None, stats: TrainStats, seed: int) -> Estimator:
        return self.build(self.resolve(params), stats, seed)

    def score_column(self, model, classes: int = 2) -> Column:
        """Class-1 probability, an array of probabilities, or the predicted value."""
        if not self.classifier:
            return F.col("prediction")
        p = vector_to_array(F.col("probability"))
        return F.get(p, F.lit(1)) if classes == 2 else p


def _boosted(p, stats, seed):
    depth = p.get("max_depth", -1)
    leaves = p.get("num_leaves")
    if leaves:
        needed = math.ceil(math.log2(leaves))
        depth = needed if depth is None or depth < 0 else min(depth, needed)
    return GBTClassifier(
        stepSize=float(p["learning_rate"]),
        maxDepth=int(min(depth, MAX_DEPTH)),
        minInstancesPerNode=max(1, int(p["min_rows"])),
        minInfoGain=float(p["min_gain"]),
        subsamplingRate=float(p["row_share"]),
        featureSubsetStrategy=str(float(p["column_share"])) if p["column_share"] < 1 else "all",
        maxBins=max(int(p["max_bin"]), stats.most_levels + 1),
        maxIter=int(p["rounds"]),
        seed=seed,
    )


def _logistic(p, stats, seed):
    return LogisticRegression(
        regParam=1.0 / (float(p["C"]) * stats.rows), elasticNetParam=0.0, standardization=False,
        maxIter=int(p["max_iter"]), tol=float(p["tol"]), family="auto",
    )


def _ridge(p, stats, seed):
    # Spark divides the penalty by the label's deviation, so it is multiplied here
    return LinearRegression(
        regParam=float(p["alpha"]) / stats.rows * (stats.label_deviation or 1.0),
        elasticNetParam=0.0, standardization=False, solver="normal",
        fitIntercept=bool(p["fit_intercept"]),
    )


def _forest(kind):
    def build(p, stats, seed):
        return kind(
            numTrees=int(p["n_estimators"]), maxDepth=int(p["max_depth"]),
            bootstrap=bool(p["bootstrap"]), maxBins=max(32, stats.most_levels + 1), seed=seed,
        )

    return build


def _perceptron(p, stats, seed):
    layers = [stats.features, *[int(h) for h in p["hidden_dims"]], stats.classes]
    return MultilayerPerceptronClassifier(
        layers=layers, maxIter=int(p["epochs"]), blockSize=int(p["block_size"]),
        stepSize=float(p["lr"]), solver=str(p["solver"]), seed=seed,
    )


# Names of the same parameters in other boosting tools, and names that are
# accepted although Spark's trees have nothing like them.
ALIASES = {
    "gbt": {
        "min_child_weight": "min_rows", "gamma": "min_gain", "colsample_bytree": "column_share",
        "subsample": "row_share", "num_boost_round": "rounds",
    },
    "gbt_leafwise": {
        "min_child_samples": "min_rows", "min_split_gain": "min_gain",
        "feature_fraction": "column_share", "bagging_fraction": "row_share", "num_iterations": "rounds",
    },
    "gbt_categorical": {
        "depth": "max_depth", "min_data_in_leaf": "min_rows", "border_count": "max_bin",
        "rsm": "column_share", "subsample": "row_share", "iterations": "rounds",
    },
}
WITHOUT_EFFECT = frozenset(
    (
        "reg_alpha", "reg_lambda", "lambda_l1", "lambda_l2", "l2_leaf_reg", "bagging_freq",
        "bagging_temperature", "random_strength", "depth_floor", "n_jobs", "tree_method",
        "grow_policy", "task_type", "early_stopping_rounds", "verbosity", "verbose",
    )
)

# Default parameters of the three boosting presets and the other models.
# "rounds" stands in for open-ended boosting, which stops early; raise it for real runs.
LEARNERS = {
    "gbt": Learner(
        "gbt", "auc", _boosted, trees=True, boosted=True, aliases=ALIASES["gbt"],
        defaults={
            "learning_rate": 0.1, "max_depth": 7, "min_rows": 10.0, "min_gain": 0.0,
            "column_share": 0.8, "row_share": 0.8, "max_bin": 512, "rounds": 20,
        },
    ),
    "gbt_leafwise": Learner(
        "gbt_leafwise", "auc", _boosted, trees=True, boosted=True, aliases=ALIASES["gbt_leafwise"],
        defaults={
            "learning_rate": 0.1, "num_leaves": 500, "max_depth": -1, "min_rows": 100,
            "min_gain": 0.0, "column_share": 0.8, "row_share": 0.8, "max_bin": 255, "rounds": 20,
        },
    ),
    "gbt_categorical": Learner(
        "gbt_categorical", "auc", _boosted, trees=True, boosted=True, aliases=ALIASES["gbt_categorical"],
        defaults={
            "learning_rate": 0.1, "max_depth": 6, "min_rows": 1, "min_gain": 0.0,
            "column_share": 1.0, "row_share": 1.0, "max_bin": 128, "rounds": 20,
        },
    ),
    "logreg": Learner(
        "logreg", "logloss", _logistic, weighted=False,
        defaults={"C": 1.0, "max_iter": 1000, "tol": 1e-6},
    ),
    "ridge": Learner(
        "ridge", "rmse", _ridge, classifier=False, weighted=False,
        defaults={"alpha": 1.0, "fit_intercept": True},
    ),
    "rf_clf": Learner(
        "rf_clf", "logloss", _forest(RandomForestClassifier), trees=True, weighted=False,
        defaults={"n_estimators": 100, "max_depth": 16, "bootstrap": True},
    ),
    "rf_reg": Learner(
        "rf_reg", "rmse", _forest(RandomForestRegressor), classifier=False, trees=True, weighted=False,
        defaults={"n_estimators": 100, "max_depth": 16, "bootstrap": True},
    ),
    "mlp": Learner(
        "mlp", "logloss", _perceptron, weighted=False,
        defaults={"hidden_dims": [256, 128], "epochs": 100, "block_size": 128, "lr": 0.03, "solver": "l-bfgs"},
    ),
}


@dataclass
class Prepared:
    """Model input: reserved columns and one feature vector per row."""

    data: DataFrame
    names: list[str]
    most_levels: int
    assembler: VectorAssembler
    facts: dict[int | None, TrainStats] | None = None  # per left-out fold, once asked for

    def release(self) -> None:
        self.data.unpersist()


def prepare(
    df: DataFrame, learner: Learner, layout: Layout = DEFAULT, persist: bool = True,
    max_levels: int = MAX_LEVELS, ordered: Sequence[str] = (),
) -> Prepared:
    """Turn a feature table into model input.

    String columns are coded once for train and test rows together. Trees get them as
    nominal features; a column with over ``max_levels`` levels is an error, unless it is in
    ``ordered``, whose columns are ordered codes. Encode it by label means otherwise.
    Missing numbers are a value below all others for trees, the mean for other models.
    """
    text, numbers = categorical_columns(df, layout), numeric_columns(df, layout)
    if text and not learner.trees:
        raise ValueError(f"{learner.name} needs numeric features, not {text}")
    out, most, metadata = df, 0, {}
    if text:
        codes = LabelCodes.fit(out, text, layout=layout)
        out = codes.transform(out, as_text=False, layout=layout)
        for name in text:
            # the levels that were counted, and one for NULL
            levels = codes.null_code[name] + 1
            if name in ordered:
                continue
            if levels > max_levels:
                raise ValueError(f"{name} has {levels} levels, over {max_levels}: encode it or name it as ordered")
            metadata[name] = {"ml_attr": {"type": "nominal", "num_vals": levels}}
            most = max(most, levels)
    if learner.trees:
        fill = dict.fromkeys(numbers, BELOW_ALL)
    elif numbers:
        means = out.selectExpr(*[f"avg({q(c)}) as m{i}" for i, c in enumerate(numbers)]).first()
        fill = {c: means[f"m{i}"] or 0.0 for i, c in enumerate(numbers)}
    else:
        fill = {}
    weighted = learner.weighted and layout.weight in df.columns
    kept = [layout.id, layout.split, layout.fold, layout.label]
    cells = [col(layout.label).cast("double").alias(c) if c == layout.label else col(c)
             for c in kept if c in out.columns]
    if weighted:
        cells.append(F.coalesce(col(layout.weight).cast("double"), F.lit(1.0)).alias(layout.weight))
    names = numbers + text
    cells += [F.coalesce(col(c).cast("double"), F.lit(float(fill[c]))).alias(c) for c in numbers]
    cells += [col(c).alias(c, metadata=metadata.get(c, {})) for c in text]
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    flat = out.select(*cells)
    reserved = [q(c) for c in flat.columns if c not in names]
    data = assembler.transform(flat).select(*reserved, "features")
    if persist:
        # the same rows feed every fold and every pass of a fit; lost blocks are recomputed
        data = data.persist()
    return Prepared(data, names, most, assembler)
