"""Tables the registered queries run on, as DataFrames and as SQL for the checks.

``campaign`` gives every order the shape of a campaign record: a skewed price, a
signed balance, counts with sentinel values, string categories, a split and two
labels. The other tables are whole-table variants of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.layout import Layout

PLANTED = Layout(label="target_planted")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def campaign(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum("l_quantity").alias("qty"),
        F.max("l_shipdate").alias("last_ship"),
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("has_r"),
    )
    orders = table(spark, sf, "orders")
    rows = (
        orders.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    )
    planted = F.expr("o_totalprice + 20*c_acctbal + 30000*((o_orderkey*7919) % 11) > 500000")
    return rows.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("price"),
        F.col("c_acctbal").alias("balance"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("qty", F.lit(0.0)).alias("qty"),
        F.coalesce(F.datediff("last_ship", "o_orderdate"), F.lit(-1)).cast("long").alias("ship_gap"),
        F.col("o_orderstatus").alias("status"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("nation"),
        F.when(F.coalesce("has_r", F.lit(0)) == 1, "yes").otherwise("no").alias("returned"),
        F.when(F.col("o_orderkey") % 5 == 0, "test").otherwise("train").alias("split"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("target"),
        planted.cast("int").alias("target_planted"),
    )


CAMPAIGN_FEATURES = ["price", "balance", "n_items", "qty", "ship_gap", "status", "segment", "nation", "returned"]
CAMPAIGN = """li as (select l_orderkey, count(*) n_items, sum(l_quantity) qty,
    max(l_shipdate) last_ship, max(case when l_returnflag='R' then 1 else 0 end) has_r
  from lineitem group by l_orderkey),
campaign as (select o_orderkey as id, o_totalprice as price, c_acctbal as balance,
    cast(coalesce(n_items,0) as bigint) as n_items, coalesce(qty,0.0) as qty,
    cast(coalesce(date_diff('day', o_orderdate, last_ship),-1) as bigint) as ship_gap,
    o_orderstatus as status, c_mktsegment as segment, n_name as nation,
    case when coalesce(has_r,0)=1 then 'yes' else 'no' end as returned,
    case when o_orderkey % 5 = 0 then 'test' else 'train' end as split,
    cast(o_orderpriority in ('1-URGENT','2-HIGH') as int) as target,
    cast(o_totalprice + 20*c_acctbal + 30000*((o_orderkey*7919) % 11) > 500000 as int)
      as target_planted
  from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey
  left join li on l_orderkey=o_orderkey)"""


def campaign_null(spark: SparkSession, sf: str) -> DataFrame:
    """Campaign with missing values and a level that only test rows have."""
    unseen = (F.col("id") % 400 == 5) & (F.col("split") == "test")
    return campaign(spark, sf).select(
        "id",
        F.when(F.col("id") % 17 != 0, F.col("segment")).alias("segment"),
        F.when(F.col("id") % 13 != 0, F.col("balance")).alias("balance"),
        F.when(unseen, "UNSEEN").otherwise(F.col("status")).alias("status"),
        "split",
        "target",
    )


CAMPAIGN_NULL = (
    CAMPAIGN
    + """,
campaign_null as (select id, case when id % 17 = 0 then null else segment end as segment,
    case when id % 13 = 0 then null else balance end as balance,
    case when id % 400 = 5 and split='test' then 'UNSEEN' else status end as status,
    split, target from campaign)"""
)


def original(spark: SparkSession, sf: str) -> DataFrame:
    """Extra labelled rows with a yes/no label: one per customer that ordered."""
    joined = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    return joined.groupBy("c_custkey").agg(
        F.max("o_totalprice").alias("price"),
        F.max("c_acctbal").alias("balance"),
        F.count(F.lit(1)).alias("n_items"),
        F.max("c_mktsegment").alias("segment"),
        F.min("o_orderstatus").alias("status"),
        F.max(F.when(F.col("o_orderpriority") == "1-URGENT", "yes").otherwise("no")).alias("y"),
    ).select((-F.col("c_custkey")).alias("id"), "price", "balance", "n_items", "segment", "status", "y")


ORIGINAL = """original as (select -c_custkey as id, max(o_totalprice) price, max(c_acctbal) balance,
    cast(count(*) as bigint) n_items, max(c_mktsegment) segment, min(o_orderstatus) status,
    max(case when o_orderpriority='1-URGENT' then 'yes' else 'no' end) y
  from orders join customer on o_custkey=c_custkey group by c_custkey)"""


def docs_labeled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a quality label as train rows, the others as test rows."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs.drop("text").join(labels.drop("toxic"), "doc_id", "left").select(
        F.col("doc_id").alias("id"), "lang", "source", "n_chars",
        F.col("quality").alias("target"),
        F.when(F.col("quality").isNull(), "test").otherwise("train").alias("split"),
    )


DOCS_LABELED = """docs_labeled as (select d.doc_id as id, lang, source, n_chars, quality as target,
    case when quality is null then 'test' else 'train' end as split
  from documents d left join labels l on l.doc_id=d.doc_id)"""


def preds(spark: SparkSession, sf: str) -> DataFrame:
    """Three pseudo-models in long form."""
    models = F.array(
        F.struct(F.lit("m1").alias("model_id"), (F.col("price") / 500000).alias("pred")),
        F.struct(F.lit("m2").alias("model_id"), ((F.col("balance") + 1000) / 11000).alias("pred")),
        F.struct(F.lit("m3").alias("model_id"), (F.col("qty") / 500).alias("pred")),
    )
    return campaign(spark, sf).select("id", "split", F.explode(models).alias("m")).select(
        "id", "m.model_id", "split", "m.pred"
    )


PREDS = (
    CAMPAIGN
    + """,
preds as (select id,'m1' as model_id,split,price/500000 as pred from campaign
  union all select id,'m2',split,(balance+1000)/11000 from campaign
  union all select id,'m3',split,qty/500 from campaign)"""
)


def preds_multi(spark: SparkSession, sf: str) -> DataFrame:
    """Three class probabilities per row and a class label."""
    total = F.expr("price/500000+(balance+1000)/11000+0.5")
    return campaign(spark, sf).select(
        "id", "split",
        (F.expr("price/500000") / total).alias("p0"),
        (F.expr("(balance+1000)/11000") / total).alias("p1"),
        (F.lit(0.5) / total).alias("p2"),
        (F.col("id") % 3).cast("int").alias("target"),
    )


PREDS_MULTI = (
    CAMPAIGN
    + """,
preds_multi as (select id, split, (price/500000)/(price/500000+(balance+1000)/11000+0.5) as p0,
    ((balance+1000)/11000)/(price/500000+(balance+1000)/11000+0.5) as p1,
    0.5/(price/500000+(balance+1000)/11000+0.5) as p2, cast(id % 3 as int) as target
  from campaign)"""
)


def trials(spark: SparkSession, sf: str) -> DataFrame:
    """A study table with some unscored trials."""
    return table(spark, sf, "part").select(
        F.lit("study_a").alias("study"), F.col("p_partkey").alias("trial"),
        F.col("p_size").alias("max_depth"), F.col("p_type").alias("activation"),
        F.when(F.col("p_partkey") % 10 != 0, F.col("p_retailprice") / 1000).alias("value"),
    )


TRIALS = """trials as (select 'study_a' as study, p_partkey as trial, p_size as max_depth,
    p_type as activation,
    case when p_partkey % 10 = 0 then null else p_retailprice/1000 end as value from part)"""


# fold rule shared by both engines
FOLD = "cast((row_number() over (partition by {label} order by md5('42_'||cast(id as varchar)), id)-1) % 5 as int)"
