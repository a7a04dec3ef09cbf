"""Registered queries: sources, sinks, columns, unions, joins."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from catalog import fixtures as fx
from rowloom.functions import scalars
from rowloom.operators import columns, joins, sets
from rowloom.session import fresh_path
from rowloom.sources import bucketed, stores, tables

RENAME = {"id": "row_id", "returned": "default", "no_such_column": "x"}


def src_csv(spark, sf):
    path = fresh_path(spark, "csv")
    tables.write_csv(fx.campaign(spark, sf), path)
    return tables.read_csv(spark, path, fx.campaign(spark, sf).schema)


def src_csv_inferred(spark, sf):
    path = fresh_path(spark, "csv")
    tables.write_csv(fx.table(spark, sf, "customer"), path)
    return tables.read_csv(spark, path).select(
        F.col("c_custkey").cast("long"), "c_name", "c_acctbal", "c_mktsegment"
    )


def src_parquet(spark, sf):
    rows = tables.read_parquet(spark, f"{sf}/orders.parquet")
    return rows.where("o_totalprice > 250000").select("o_orderkey", "o_orderstatus", "o_totalprice")


def sink_parquet(spark, sf):
    path = tables.write_features(fx.campaign(spark, sf), fresh_path(spark, "features"), 1)
    return spark.read.parquet(path).groupBy("split", "segment").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("price").alias("max_price")
    )


def pred_store(spark, sf):
    store = stores.PredictionStore(spark, fresh_path(spark, "preds"))
    long = fx.preds(spark, sf)
    for model in ("m1", "m2", "m3"):
        mine = long.where(F.col("model_id") == model)
        store.save(mine.where("split = 'train'"), "base", model, "oof")
        store.save(mine.where("split = 'test'"), "base", model, "test_single")
    oof = store.load("base", ["m1", "m3"], "oof").withColumn("kind", F.lit("oof"))
    test = store.load("base", ["m1", "m3"], "test_single").withColumn("kind", F.lit("test_single"))
    return oof.unionByName(test)


def submission(spark, sf):
    test = fx.preds(spark, sf).where("model_id = 'm2' and split = 'test'")
    path = fresh_path(spark, "submission")
    tables.write_csv(tables.submission(test, "pred", name="answer"), path)
    return tables.read_csv(spark, path, "id long, answer double")


def trial_store(spark, sf):
    """Two appends, a resume that skips stored trials, and a deleted second study."""
    store = stores.TrialStore(spark, fresh_path(spark, "trials"))
    table = fx.trials(spark, sf).select(
        "trial",
        F.create_map(F.lit("max_depth"), F.col("max_depth").cast("string")).alias("params"),
        "value",
        F.when(F.col("value").isNull(), "fail").otherwise("complete").alias("state"),
    )
    store.append("a", table.where("trial % 3 = 0"))
    store.append("b", table)
    store.append("a", store.remaining("a", table))
    store.delete("b")
    both = store.load("a").unionByName(store.load("b"))
    return both.select(
        "study", "trial", F.col("params")["max_depth"].cast("int").alias("max_depth"), "value", "state"
    )


def proj_rename(spark, sf):
    return columns.rename_known(fx.campaign(spark, sf), RENAME).drop("target_planted", "nothing")


def proj_drop_pattern(spark, sf):
    return columns.drop_matching(fx.campaign(spark, sf), "_planted")


def proj_by_dtype(spark, sf):
    df = fx.campaign(spark, sf)
    return df.select("id", *columns.categorical_columns(df), *columns.numeric_columns(df))


def label_map(spark, sf):
    return columns.map_label(fx.campaign(spark, sf), "returned", {"yes": 1, "no": 0}).select(
        "id", "returned"
    )


def indicator_flags(spark, sf):
    return fx.campaign(spark, sf).select(
        "id",
        columns.positive_flag("n_items").alias("has_items"),
        columns.differs_flag("ship_gap", -1).alias("has_gap"),
    )


def cast_all(spark, sf):
    df = fx.campaign(spark, sf).select("id", "n_items", "ship_gap", "price", "balance")
    df = columns.cast_columns(df, ["n_items", "ship_gap"], "string")
    return columns.cast_columns(df, ["price", "balance"], "float")


def weight_default(spark, sf):
    bare = columns.default_weight(fx.campaign(spark, sf)).select("id", "weight")
    given = fx.campaign_null(spark, sf).withColumn("weight", F.col("balance") / 100)
    given = columns.default_weight(given).select((-F.col("id")).alias("id"), "weight")
    return bare.unionByName(given)


def class1_prob(spark, sf):
    """The same probability out of a number, a one-entry array, a pair and an ML vector."""
    df = fx.campaign(spark, sf).select("id", ((F.col("balance") + 1000) / 11000).alias("p"))
    df = df.select(
        "id", "p", F.array("p").alias("one"), F.array(1 - F.col("p"), "p").alias("two"),
        array_to_vector(F.array(1 - F.col("p"), "p")).alias("vec"),
    )
    return df.select("id", *[columns.class1_probability(df, c).alias(c) for c in ("p", "one", "two", "vec")])


def placeholder_column(spark, sf):
    test = fx.campaign(spark, sf).where("split = 'test'").select("id", "price")
    return columns.placeholder(test, "target", 0, "long")


def prefix_limit(spark, sf):
    return columns.first_rows(fx.campaign(spark, sf).select("id", "price", "segment"), 1000)


def union_by_name(spark, sf):
    campaign = fx.campaign(spark, sf).where("split = 'train'")
    base = campaign.select("id", "price", "balance", "n_items", "segment", "status", "target")
    extra = columns.rename_known(
        columns.map_label(fx.original(spark, sf), "y", {"yes": 1, "no": 0}), {"y": "target"}
    ).drop("status")
    return sets.union_lenient(base, extra.withColumn("target", F.col("target").cast("int")))


def union_strict(spark, sf):
    train = fx.campaign(spark, sf).where("split = 'train'").select("id", "price", "segment", "target")
    test = fx.campaign(spark, sf).where("split = 'test'").select("id", "price", "segment")
    return sets.union_strict(train, columns.placeholder(test, "target", 0, "int"))


def split_restore(spark, sf):
    """Union of both parts, taken apart again, with the label gone from the test part."""
    df = fx.campaign(spark, sf).select("id", "price", "split", "target")
    train, test = sets.split_back(sets.tag_union(*sets.split_back(df)))
    return sets.union_lenient(
        train.withColumn("part", F.lit("a")), test.withColumn("part", F.lit("b"))
    )


def hconcat_join(spark, sf):
    df = fx.campaign(spark, sf)
    return joins.side_by_side(
        df.select("id", "price", "balance"), df.select("id", "segment", "status"), df.select("id", "qty")
    )


def hconcat_bucketed(spark, sf):
    """The same blocks from tables bucketed by id."""
    df = fx.campaign(spark, sf)
    store = bucketed.BucketedStore(spark, fresh_path(spark, "bucketed"), buckets=8)
    blocks = {"numbers": ["price", "balance"], "texts": ["segment", "status"], "counts": ["qty"]}
    for name, columns in blocks.items():
        store.save(df.select("id", *columns), name)
    return store.side_by_side(*blocks)


def attach_label(spark, sf):
    df = fx.campaign(spark, sf)
    return joins.attach_label(df.select("id", "price"), df.where("split = 'train'"))


def lookup_join(spark, sf):
    """Per-nation averages looked up for every row, by broadcast and by the shuffled way."""
    df = fx.campaign_null(spark, sf).select("id", "segment")
    stats = fx.campaign(spark, sf).where("segment <> 'BUILDING'").groupBy("segment").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("balance").alias("mean")
    )
    near = joins.lookup(df, stats, ["segment"], ["mean"], "rows", F.col("id"))
    far = joins.lookup(df, stats, ["segment"], ["mean"], "rows", F.col("id"), max_rows=0)
    return near.select("id", "segment", F.round("mean", 6).alias("near")).join(
        far.select("id", F.round("mean", 6).alias("far")), "id"
    )


def scalar_functions(spark, sf):
    """The scalar helpers on whole columns; a missing balance is filled with the average."""
    df = fx.campaign_null(spark, sf).join(fx.campaign(spark, sf).select("id", "price", "n_items"), "id")
    mean = fx.campaign_null(spark, sf).agg(F.avg("balance").alias("mean")).first()["mean"]
    x = F.col("balance")
    return df.select(
        "id",
        F.round(F.sqrt("price"), 6).alias("root"),
        F.round(F.log2(F.col("n_items") + 1), 9).alias("log2"),
        F.round(scalars.sigmoid(x / 1000), 9).alias("sigmoid"),
        scalars.clip(x, 0.0, 5000.0).alias("clipped"),
        scalars.percent_text(scalars.ratio(F.col("n_items"), F.lit(16))).alias("percent"),
        F.round(F.coalesce(x, F.lit(mean)), 5).alias("filled"),
        x.isNull().cast("int").alias("missing"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        scalar_functions, src_csv, src_csv_inferred, src_parquet, sink_parquet, pred_store, submission, trial_store,
        proj_rename, proj_drop_pattern, proj_by_dtype, label_map, indicator_flags, cast_all,
        weight_default, class1_prob, placeholder_column, prefix_limit, union_by_name, union_strict,
        split_restore, hconcat_join, hconcat_bucketed, attach_label, lookup_join,
    )
}

C = fx.CAMPAIGN
SQL = {
    "src_csv": f"with {C} select * from campaign",
    "src_csv_inferred": "select c_custkey, c_name, c_acctbal, c_mktsegment from customer",
    "src_parquet": "select o_orderkey, o_orderstatus, o_totalprice from orders where o_totalprice > 250000",
    "sink_parquet": f"""with {C} select split, segment, count(*) as n_rows, max(price) as max_price
        from campaign group by split, segment""",
    "pred_store": f"""with {fx.PREDS} select model_id, id, pred,
        case when split='train' then 'oof' else 'test_single' end as kind
        from preds where model_id in ('m1','m3')""",
    "submission": f"""with {fx.PREDS} select id, pred as answer from preds
        where model_id='m2' and split='test'""",
    "trial_store": f"""with {fx.TRIALS} select 'a' as study, trial, max_depth, value,
        case when value is null then 'fail' else 'complete' end as state from trials""",
    "proj_rename": f"""with {C} select id as row_id, price, balance, n_items, qty, ship_gap, status,
        segment, nation, returned as "default", split, target from campaign""",
    "proj_drop_pattern": f"with {C} select * exclude (target_planted) from campaign",
    "proj_by_dtype": f"""with {C} select id, status, segment, nation, returned, price, balance,
        n_items, qty, ship_gap, target_planted from campaign""",
    "label_map": f"""with {C} select id, cast(case returned when 'yes' then 1 when 'no' then 0 end as bigint)
        as returned from campaign""",
    "indicator_flags": f"""with {C} select id, cast(n_items > 0 as int) as has_items,
        cast(ship_gap <> -1 as int) as has_gap from campaign""",
    "cast_all": f"""with {C} select id, cast(n_items as varchar) as n_items,
        cast(ship_gap as varchar) as ship_gap, cast(price as float) as price,
        cast(balance as float) as balance from campaign""",
    "weight_default": f"""with {fx.CAMPAIGN_NULL} select id, cast(1.0 as double) as weight from campaign
        union all select -id, coalesce(balance / 100, 1.0) from campaign_null""",
    "class1_prob": f"""with {C} select id, (balance+1000)/11000 as p, (balance+1000)/11000 as one,
        (balance+1000)/11000 as two, (balance+1000)/11000 as vec from campaign""",
    "placeholder_column": f"""with {C} select id, price, cast(0 as bigint) as target from campaign
        where split='test'""",
    "prefix_limit": f"with {C} select id, price, segment from campaign order by id limit 1000",
    "union_by_name": f"""with {C}, {fx.ORIGINAL}
        select id, price, balance, n_items, segment, status, target from campaign where split='train'
        union all select id, price, balance, n_items, segment, null, cast(y='yes' as int) from original""",
    "union_strict": f"""with {C} select id, price, segment, case when split='train' then target else 0 end
        as target from campaign""",
    "split_restore": f"""with {C} select id, price, case when split='train' then target end as target,
        case when split='train' then 'a' else 'b' end as part from campaign""",
    "hconcat_join": f"with {C} select id, price, balance, segment, status, qty from campaign",
    "hconcat_bucketed": f"with {C} select id, price, balance, segment, status, qty from campaign",
    "attach_label": f"""with {C} select id, price, case when split='train' then target end as target
        from campaign""",
    "scalar_functions": f"""with {fx.CAMPAIGN_NULL} select n.id, round(sqrt(price),6) as root,
        round(log2(n_items+1),9) as log2, round(1/(1+exp(-n.balance/1000)),9) as sigmoid,
        case when n.balance is not null then least(greatest(n.balance,0.0),5000.0) end as clipped,
        printf('%.2f%%', n_items*100.0/16) as percent,
        round(coalesce(n.balance, (select avg(balance) from campaign_null)),5) as filled,
        cast(n.balance is null as int) as missing from campaign_null n join campaign c on c.id=n.id""",
    "lookup_join": f"""with {fx.CAMPAIGN_NULL}, st as (select segment, round(avg(balance),6) m from campaign
        where segment <> 'BUILDING' group by segment)
        select id, n.segment, m as near, m as far from campaign_null n left join st on st.segment=n.segment""",
}
