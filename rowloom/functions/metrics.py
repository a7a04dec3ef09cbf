"""Exact metrics over prediction tables, whole or per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.scalars import ratio
from rowloom.operators.columns import col
from rowloom.operators.ordering import bucket_columns, sketch_edges

EPS = 2.220446049250313e-16  # float64 machine epsilon

# whether a larger value of the metric is the better one
HIGHER_IS_BETTER = {
    "auc": True,
    "accuracy": True,
    "r2": True,
    "logloss": False,
    "mlogloss": False,
    "rmse": False,
    "rmsle": False,
}


def direction(metric: str) -> str:
    return "maximize" if HIGHER_IS_BETTER[metric] else "minimize"


def auc(
    df: DataFrame,
    score: str,
    label: str,
    by: Sequence[str] = (),
    out: str = "auc",
    buckets: int | None = None,
    count: str | None = None,
) -> DataFrame:
    """ROC-AUC with half credit for ties; NULL where only one class is present.

    With ``count``, a row stands for as many as that column says.

    Rows are first counted per distinct score. Scores are cut into ordered buckets;
    running counts are taken inside a bucket, and a bucket adds the negatives of
    the lower buckets to all its positives at once.
    """
    by = list(by)
    rows = df.where(col(score).isNotNull() & col(label).isNotNull()).select(
        *[col(b) for b in by],
        col(score).cast("double").alias("_score"),
        (col(label) == 1).cast("long").alias("_pos"),
        (col(count) if count else F.lit(1)).cast("long").alias("_rows"),
    )
    cut = bucket_columns(rows, {"_score": sketch_edges(rows, "_score", buckets)}, "_b")
    ties = cut.groupBy(*by, "_b_score", "_score").agg(
        F.sum(F.col("_pos") * F.col("_rows")).alias("_p"), F.sum((1 - F.col("_pos")) * F.col("_rows")).alias("_n")
    )
    lower = Window.partitionBy(*by, "_b_score").orderBy("_score")
    lower = lower.rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_n").over(lower), F.lit(0)).cast("double")
    per_bucket = (
        ties.withColumn("_won", F.col("_p") * (below + F.col("_n") / 2))
        .groupBy(*by, "_b_score")
        .agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"), F.sum("_won").alias("_won"))
    )
    earlier = Window.partitionBy(*by, F.lit(0)).orderBy("_b_score")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("double")
    return (
        per_bucket.withColumn("_won", F.col("_won") + F.col("_p") * passed)
        .groupBy(*by)
        .agg(
            ratio(
                F.sum("_won"), F.sum("_p").cast("double") * F.sum("_n").cast("double")
            ).alias(out)
        )
    )


def log_loss(score: Column, label: Column) -> Column:
    """Mean binary log-loss of probabilities clipped away from 0 and 1."""
    p = F.least(F.greatest(score, F.lit(EPS)), F.lit(1 - EPS))
    return F.avg(F.when(label == 1, -F.log(p)).otherwise(-F.log(1 - p)))


def multi_log_loss(scores: Sequence[Column], label: Column) -> Column:
    """Mean log-loss over classes 0..k-1, given one probability column per class."""
    total = sum(scores[1:], scores[0])
    picked = F.get(F.array(*scores), label.cast("int")) / total
    return F.avg(-F.log(F.least(F.greatest(picked, F.lit(EPS)), F.lit(1 - EPS))))


def accuracy(predicted: Column, label: Column) -> Column:
    return F.avg((predicted == label).cast("double"))


def rmse(predicted: Column, label: Column) -> Column:
    return F.sqrt(F.avg((label - predicted) * (label - predicted)))


def rmsle(predicted: Column, label: Column) -> Column:
    gap = F.log1p(label) - F.log1p(predicted)
    return F.sqrt(F.avg(gap * gap))


def r2(predicted: Column, label: Column) -> Column:
    """1 - residual / total sum of squares, from one pass over the rows."""
    gap = label - predicted
    return 1 - ratio(F.sum(gap * gap), F.var_pop(label) * F.count(label))


def score_table(
    df: DataFrame,
    metric: str,
    score: str,
    label: str,
    by: Sequence[str] = (),
    out: str = "value",
) -> DataFrame:
    """Any single-score metric, whole or per group, as one row per group."""
    if metric == "auc":
        return auc(df, score, label, by, out)
    p, y = col(score), col(label)
    if metric == "accuracy":
        value = accuracy((p >= 0.5).cast("int"), y)
    else:
        value = {"logloss": log_loss, "rmse": rmse, "rmsle": rmsle, "r2": r2}[metric](p, y)
    return df.groupBy(*[col(b) for b in by]).agg(value.alias(out))
