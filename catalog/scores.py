"""Registered queries: metrics over prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from rowloom.functions import metrics
from rowloom.operators import folds
from rowloom.session import settle

D = 9


def scored(spark, sf, with_fold=True):
    """Train rows with a probability, a value, a prediction of it, and a fold."""
    df = fx.campaign(spark, sf)
    if with_fold:
        df = settle(folds.stratified_folds(df), "folds")
    return df.where("split = 'train'").select(
        "id", *(["fold"] if with_fold else []), "target", "target_planted", "n_items",
        ((F.col("balance") + 1000) / 11000).alias("p"),
        F.col("price").alias("y"), (F.col("qty") * 2500).alias("guess"),
    )


def _one(value, name="value"):
    return F.round(value, D).alias(name)


def metric_auc(spark, sf):
    """Without and with heavy ties."""
    df = scored(spark, sf, False)
    fine = metrics.auc(df, "p", "target_planted", out="fine")
    tied = metrics.auc(df, "n_items", "target", out="tied")
    tied = tied.first()["tied"]
    return fine.select(_one(F.col("fine"), "fine"), _one(F.lit(tied), "tied"))


def metric_logloss(spark, sf):
    return scored(spark, sf, False).agg(_one(metrics.log_loss(F.col("p"), F.col("target"))))


def metric_mlogloss(spark, sf):
    df = fx.preds_multi(spark, sf)
    return df.agg(_one(metrics.multi_log_loss([F.col(f"p{i}") for i in range(3)], F.col("target"))))


def metric_accuracy(spark, sf):
    return scored(spark, sf, False).agg(
        _one(metrics.accuracy((F.col("p") >= 0.5).cast("int"), F.col("target")))
    )


def metric_rmse(spark, sf):
    return scored(spark, sf, False).agg(F.round(metrics.rmse(F.col("guess"), F.col("y")), 4).alias("value"))


def metric_r2(spark, sf):
    return scored(spark, sf, False).agg(_one(metrics.r2(F.col("guess"), F.col("y"))))


def metric_rmsle(spark, sf):
    return scored(spark, sf, False).agg(_one(metrics.rmsle(F.col("guess"), F.col("y"))))


def metric_by_fold(spark, sf):
    df = scored(spark, sf)
    parts = [
        metrics.score_table(df, m, s, y, ["fold"]).withColumn("metric", F.lit(m))
        for m, s, y in (
            ("auc", "p", "target"), ("logloss", "p", "target"), ("accuracy", "p", "target"),
            ("rmse", "guess", "y"), ("r2", "guess", "y"), ("rmsle", "guess", "y"),
        )
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("metric", "fold", F.round("value", 6).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        metric_auc, metric_logloss, metric_mlogloss, metric_accuracy, metric_rmse, metric_r2,
        metric_rmsle, metric_by_fold,
    )
}

SCORED = (
    fx.CAMPAIGN
    + f""",
scored as (select id, {fx.FOLD.format(label='target')} as fold, target, target_planted, n_items,
    (balance+1000)/11000 as p, price as y, qty*2500 as guess from campaign where split='train')"""
)


def auc_sql(score, label, view="scored", by=None):
    """Rank form of the area: mean rank of the positives among all rows, ties averaged."""
    part = f"partition by {by} " if by else ""
    inner = f"""select {by + ',' if by else ''} {label} y,
        rank() over ({part}order by {score}) + (count(*) over (partition by {by + ',' if by else ''} {score}) - 1)/2.0 r
        from {view}"""
    area = """(sum(case when y=1 then r end) - sum(y)*(sum(y)+1)/2.0)
        / nullif(cast(sum(y) as double)*(count(*)-sum(y)), 0)"""
    return f"select {by + ',' if by else ''} {area} as value from ({inner}){' group by ' + by if by else ''}"


LOGLOSS = "avg(case when target=1 then -ln(least(greatest(p,2.220446049250313e-16),1-2.220446049250313e-16)) else -ln(1-least(greatest(p,2.220446049250313e-16),1-2.220446049250313e-16)) end)"
RMSE = "sqrt(avg((y-guess)*(y-guess)))"
R2 = "1-sum((y-guess)*(y-guess))/(var_pop(y)*count(*))"
RMSLE = "sqrt(avg((ln(1+y)-ln(1+guess))*(ln(1+y)-ln(1+guess))))"
ACC = "avg(cast(cast(p>=0.5 as int)=target as int))"

SQL = {
    "metric_auc": f"""with {SCORED} select round(a.value,{D}) as fine, round(b.value,{D}) as tied
        from ({auc_sql('p', 'target_planted')}) a cross join ({auc_sql('n_items', 'target')}) b""",
    "metric_logloss": f"with {SCORED} select round({LOGLOSS},{D}) as value from scored",
    "metric_mlogloss": f"""with {fx.PREDS_MULTI} select
        round(avg(-ln(case target when 0 then p0 when 1 then p1 else p2 end/(p0+p1+p2))),{D}) as value
        from preds_multi""",
    "metric_accuracy": f"with {SCORED} select round({ACC},{D}) as value from scored",
    "metric_rmse": f"with {SCORED} select round({RMSE},4) as value from scored",
    "metric_r2": f"with {SCORED} select round({R2},{D}) as value from scored",
    "metric_rmsle": f"with {SCORED} select round({RMSLE},{D}) as value from scored",
    "metric_by_fold": f"with {SCORED} select 'auc' as metric, fold, round(value,6) as value from ({auc_sql('p', 'target', by='fold')})"
    + "".join(
        f" union all select '{m}', fold, round({x},6) from scored group by fold"
        for m, x in (("logloss", LOGLOSS), ("accuracy", ACC), ("rmse", RMSE), ("r2", R2), ("rmsle", RMSLE))
    ),
}
