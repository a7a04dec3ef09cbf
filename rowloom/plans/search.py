"""Parameter search: spaces, candidate tables, the search loop and reports on trials."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from threading import Lock

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions import metrics
from rowloom.functions.scalars import hash_uniform, ratio
from rowloom.layout import DEFAULT, Layout
from rowloom.operators.columns import col
from rowloom.operators.joins import lookup
from rowloom.operators.ordering import average_ranks, running_extreme
from rowloom.plans.cv import _in_threads, _learner, fit_one_fold
from rowloom.plans.models import Learner, prepare
from rowloom.session import settle
from rowloom.sources.stores import TRIAL_SCHEMA, TrialStore


@dataclass(frozen=True)
class Dim:
    """One parameter: a range (float or int, linear or log, with or without step) or a choice.

    ``below`` names an earlier parameter that is the upper end of this one's range.
    ``sql`` gives a parameter that follows from the others.
    """

    name: str
    kind: str = "float"
    low: float = 0.0
    high: float = 1.0
    step: float | None = None
    log: bool = False
    choices: tuple = ()
    below: str | None = None
    sql: str | None = None


def _draw(dim: Dim, u: Column) -> Column:
    if dim.sql is not None:
        return F.expr(dim.sql)
    if dim.kind == "choice":
        at = F.floor(u * len(dim.choices)).cast("int")
        return F.get(F.array(*[F.lit(c) for c in dim.choices]), at)
    high = col(dim.below) if dim.below else F.lit(dim.high)
    low = F.lit(dim.low)
    if dim.step is None and dim.kind == "int":
        step = 1
    else:
        step = dim.step
    if step is not None:
        steps = F.floor((high - low) / step + 1e-9) + 1
        value = low + F.floor(u * steps) * step
    elif dim.log:
        value = F.exp(F.log(low) + u * (F.log(high) - F.log(low)))
    else:
        value = low + u * (high - low)
    return value.cast("long") if dim.kind == "int" else value.cast("double")


def candidates(trials: DataFrame, space: Sequence[Dim], seed: int = 42) -> DataFrame:
    """Parameter values for every row of ``trials``, drawn from a hash of seed, trial and name."""
    out = trials.select("trial")
    for dim in space:
        out = out.withColumn(dim.name, _draw(dim, hash_uniform(seed, F.col("trial"), F.lit(dim.name))))
    return out


# The ranges that are searched per model; depths end at the deepest tree that Spark grows.
SPACES: dict[str, tuple[Dim, ...]] = {
    "gbt": (
        Dim("learning_rate", low=0.01, high=0.03),
        Dim("max_depth", "int", 3, 30),
        Dim("min_rows", low=0, high=100),
        Dim("column_share", low=0.3, high=0.6),
        Dim("row_share", low=0.5, high=0.9),
    ),
    "gbt_leafwise": (
        Dim("learning_rate", low=0.02, high=0.02),
        Dim("depth_floor", "int", 5, 20),
        Dim("num_leaves", "int", 300, 1200),
        Dim("min_rows", "int", 100, 20000),
        Dim("min_gain", low=1e-5, high=10, log=True),
        Dim("column_share", low=0.3, high=1.0),
        Dim("row_share", low=0.65, high=1.0),
        Dim("max_depth", sql="greatest(depth_floor, cast(floor(log2(num_leaves)) as bigint) + 1)"),
    ),
    "gbt_categorical": (
        Dim("learning_rate", low=0.02, high=0.02),
        Dim("max_depth", "int", 3, 16),
        Dim("min_rows", low=10, high=100),
        Dim("max_bin", "int", 128, 255),
    ),
    "logreg": (Dim("C", low=1e-2, high=1e2, log=True),),
    "ridge": (Dim("alpha", low=1e-2, high=1e2, log=True),),
    "rf_reg": (Dim("n_estimators", "int", 50, 100), Dim("max_depth", "int", 4, 20)),
    "rf_clf": (Dim("n_estimators", "int", 50, 150), Dim("max_depth", "int", 4, 30)),
    "mlp": (
        Dim("hidden_dim1", "int", 256, 1024, step=32),
        Dim("hidden_dim2", "int", 128, step=32, below="hidden_dim1"),
        Dim("hidden_dim3", "int", 64, step=32, below="hidden_dim2"),
        Dim("hidden_dim4", "int", 32, step=32, below="hidden_dim3"),
        Dim("block_size", "int", 512, 1120, step=32),
        Dim("lr", low=1e-3, high=1e-1, log=True),
    ),
}

def _grid_values(dim: Dim, points: int) -> list | range:
    """What a parameter can be on a grid: all choices or steps, else ``points`` values, evenly (or by ratio) from end to end."""
    if dim.kind == "choice":
        return list(dim.choices)
    if dim.step is not None or dim.kind == "int":
        step = dim.step or 1
        n = int((dim.high - dim.low) / step + 1e-9) + 1
        return [dim.low + i * step for i in range(n)]
    share = [i / max(points - 1, 1) for i in range(points)]
    if dim.log:
        return [dim.low * (dim.high / dim.low) ** x for x in share]
    return [dim.low + x * (dim.high - dim.low) for x in share]


def grid_size(space: Sequence[Dim], points: int = 5) -> int:
    """How many points the product of all parameters has."""
    size = 1
    for dim in space:
        size *= 1 if dim.sql is not None else len(_grid_values(dim, points))
    return size


def grid_candidates(trials: DataFrame, space: Sequence[Dim], points: int = 5) -> DataFrame:
    """Parameter values for every row of ``trials``: trial t is point t of the product space, the last parameter fastest.

    The number decodes in mixed radix, so any block of a grid is a plan over a range of numbers; nothing is
    enumerated. Numbers beyond the grid are left out. Derived parameters follow; ``below`` has no place on a grid.
    """
    if any(d.below for d in space):
        raise ValueError("a range that ends at another parameter has no fixed grid")
    out, stride = trials.select("trial").where((F.col("trial") >= 0) & (F.col("trial") < grid_size(space, points))), 1
    cells = {}
    for dim in reversed([d for d in space if d.sql is None]):
        values = _grid_values(dim, points)
        at = F.floor(F.col("trial") / stride).cast("long") % len(values) if stride > 1 else F.col("trial") % len(values)
        cell = F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
        cells[dim.name] = cell if dim.kind == "choice" else cell.cast("long" if dim.kind == "int" else "double")
        stride *= len(values)
    out = out.select("trial", *[cells[d.name].alias(d.name) for d in space if d.sql is None])
    for dim in space:
        if dim.sql is not None:
            out = out.withColumn(dim.name, F.expr(dim.sql))
    return out.select("trial", *[col(d.name) for d in space])


def _as_params(row: Mapping) -> dict:
    params = {k: v for k, v in row.items() if k != "trial"}
    hidden = [params.pop(k) for k in sorted(params) if k.startswith("hidden_dim")]
    return {**params, "hidden_dims": hidden} if hidden else params


def run_search(
    objective: Callable[[dict], float | None | tuple[float | None, Mapping]], space: Sequence[Dim], n_trials: int, store: TrialStore,
    study: str, initial: Mapping | None = None, seed: int = 42, parallelism: int = 1, grid: int | None = None,
) -> DataFrame:
    """Score ``n_trials`` more candidates and append them to the study.

    A study that exists is continued: what was begun by a run that ended early and has no
    trial is done again first, from the study's log of intents, whatever their numbers; then
    numbering goes on after the last, so no candidate repeats. ``initial`` is tried first. With ``grid``
    trials walk the grid of so many points a range, and end with it, instead of being drawn.
    Each trial is itself a distributed fit, and is appended as soon as it ends; one that fails is stored
    without a score. An objective that changes parameters returns the score and those it used: these are stored.
    """
    spark = store.spark
    lost = {r["trial"]: json.loads(r["drawn"]) for r in store.lost(study).collect()}
    start = store.next_number(study)
    numbers = spark.range(start, start + n_trials).select(F.col("id").alias("trial"))
    wanted = candidates(numbers, space, seed) if grid is None else grid_candidates(numbers, space, grid)
    drawn = {r["trial"]: r.asDict() for r in wanted.collect()}
    if initial is not None and n_trials:
        drawn[start] = {"trial": start, **initial}
    if drawn:
        store.intend(study, spark.createDataFrame([(t, json.dumps(p)) for t, p in drawn.items()], "trial long, drawn string"))
    drawn = lost | drawn

    def one(number):
        params = _as_params(drawn[number])
        try:
            value = objective(params)
            if isinstance(value, tuple):
                value, params = value
            state = "complete" if value is not None else "fail"
        except Exception as error:  # one bad candidate must not lose the others
            value, params, state = None, {**params, "error": str(error)}, "fail"
        row = (number, {k: str(v) for k, v in params.items()}, None if value is None else float(value), state)
        with appending:
            store.append(study, spark.createDataFrame([row], TRIAL_SCHEMA))

    appending = Lock()
    _in_threads(spark, one, sorted(drawn), parallelism)
    return store.load(study)


def search_model(
    df: DataFrame, model: str | Learner, n_trials: int, store: TrialStore, study: str | None = None,
    space: Sequence[Dim] | None = None, fixed: Mapping | None = None, initial: Mapping | None = None,
    layout: Layout = DEFAULT, seed: int = 42, fold: int = 0, parallelism: int = 1, patience: int | None = None, grid: int | None = None,
) -> DataFrame:
    """Search a model's parameters, scoring each candidate on one fold; by a grid of so many points a range with ``grid``.

    ``fixed`` holds parameters outside the space; one inside it is an error. Stored are
    the parameters of the fit, defaults included; with ``patience`` also the round kept.
    """
    learner = _learner(model)
    space = space or SPACES[learner.name]
    searched = {"hidden_dims" if d.name.startswith("hidden_dim") else learner.aliases.get(d.name, d.name) for d in space}
    clash = searched & {learner.aliases.get(n, n) for n in fixed or {}}
    if clash:
        raise ValueError(f"fixed parameters are searched: {sorted(clash)}")
    # the table is computed once; column means and the cached rows of all trials read it
    df = settle(df, "searched")
    prepared = prepare(df, learner, layout)

    def objective(params):
        used = learner.resolve({**params, **(fixed or {})})
        _, value, best = fit_one_fold(df, learner, used, fold, layout, seed, patience, prepared)
        return value, {**used, "best_iteration": best} if patience is not None and best is not None else used

    try:
        return run_search(
            objective, space, n_trials, store, study or f"{learner.name}_study",
            initial, seed, parallelism, grid,
        )
    finally:
        prepared.release()


def top_trials(trials: DataFrame, k: int, metric: str) -> DataFrame:
    """The ``k`` best scored trials, best first."""
    value = F.col("value")
    order = value.desc() if metrics.HIGHER_IS_BETTER[metric] else value.asc()
    return trials.where(value.isNotNull()).orderBy(order, "trial").limit(k)


def trial_history(trials: DataFrame, metric: str) -> DataFrame:
    """Every trial with the best score up to it, per study."""
    return running_extreme(
        trials, ["study"], "trial", "value", metrics.direction(metric), "best_so_far"
    )


def rank_correlation(df: DataFrame, a: str, b: str) -> float | None:
    """Correlation of the tie-averaged ranks of two columns, over the rows that have both."""
    x, y = (col(n).cast("double") for n in (a, b))
    pairs = df.select((x + F.lit(0.0)).alias("x"), (y + F.lit(0.0)).alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    pairs = settle(pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")), "pairs")
    # equal pairs are one row from here on; ranks count each as often as it occurs
    out = pairs
    for name in ("x", "y"):
        ranks = average_ranks(pairs, name, count="n").select(F.col("value").alias(name), F.col("rank").alias(f"r{name}"), "rows")
        out = lookup(out, ranks, [name], [f"r{name}"], "rows", F.struct("x", "y"))
    weighted = out.select(*[F.sum(F.expr(e)).alias(k) for k, e in {
        "n": "n", "sx": "n * rx", "sy": "n * ry", "sxx": "n * rx * rx", "syy": "n * ry * ry", "sxy": "n * rx * ry",
    }.items()]).first()
    if not weighted["n"]:
        return None
    n, sx, sy = weighted["n"], weighted["sx"], weighted["sy"]
    spread = (weighted["sxx"] - sx * sx / n) * (weighted["syy"] - sy * sy / n)
    return (weighted["sxy"] - sx * sy / n) / spread**0.5 if spread > 0 else None


def parameter_influence(
    trials: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), ranks: bool = False
) -> DataFrame:
    """Strength of the link between each parameter and the score, from 0 to 1.

    Absolute correlation for a number, of tie-averaged ranks with ``ranks``; for a choice, the
    root of the share of the score's variance that lies between its values.
    """
    scored = trials.where(F.col("value").isNotNull())
    out = None
    if numeric and ranks:
        # a number a parameter
        found = [(n, rank_correlation(scored, n, "value")) for n in numeric]
        out = trials.sparkSession.createDataFrame([(n, None if r is None else abs(r)) for n, r in found], "param string, influence double")
    elif numeric:
        row = scored.agg(
            *[F.abs(F.corr(col(n).cast("double"), F.col("value"))).alias(f"c{i}") for i, n in enumerate(numeric)]
        )
        cells = [
            F.struct(F.lit(n).alias("param"), F.col(f"c{i}").alias("influence"))
            for i, n in enumerate(numeric)
        ]
        out = row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    for name in categorical:
        groups = scored.where(col(name).isNotNull()).groupBy(name).agg(
            F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
        )
        total = groups.agg(
            F.sum("n").alias("n"), (F.sum(F.expr("n * m")) / F.sum("n")).alias("mean"),
            F.sum(F.expr("n * v")).alias("within"),
            F.sum(F.expr("n * m * m")).alias("squares"),
        )
        between = F.greatest(F.expr("squares - n * mean * mean"), F.lit(0.0))
        part = total.select(
            F.lit(name).alias("param"), F.sqrt(ratio(between, between + F.col("within"))).alias("influence")
        )
        out = part if out is None else out.unionByName(part)
    return out
