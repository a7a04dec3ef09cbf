"""Registered queries: preprocessing and feature recipes."""

from __future__ import annotations

from functools import partial

from pyspark.sql import types as T

from catalog import features as fq
from catalog import fixtures as fx
from rowloom.operators.columns import q
from rowloom.plans import recipes

# the campaign columns in the roles a recipe knows
ROLES = recipes.Roles(
    positive_flags=("n_items",),
    sentinel_flags={"ship_gap": -1},
    power=("balance", "price", "qty"),
    excluded=("nation",),
    sentinels={"balance": 0, "n_items": 0, "qty": 0, "ship_gap": -1},
    unbinned=("n_items",),
)
NUM = ["price", "balance", "n_items", "qty", "ship_gap"]
TEXT = ["status", "segment", "nation", "returned"]
POWER = ["balance", "price", "qty"]


def rounded(df):
    return df.selectExpr(
        *[
            f"round({q(f.name)}, 6) as {q(f.name)}" if isinstance(f.dataType, T.DoubleType) else q(f.name)
            for f in df.schema
        ]
    )


def preprocessed(version, spark, sf):
    df = fx.campaign(spark, sf).drop("target_planted").withColumnRenamed("target", "y")
    train = df.where("split = 'train'").drop("split")
    test = df.where("split = 'test'").drop("split", "y")
    return rounded(recipes.preprocess(train, test, version, fx.original(spark, sf), ROLES))


def featured(recipe, spark, sf):
    df = fx.campaign(spark, sf).drop("target_planted")
    return rounded(recipes.features(df, recipe, ROLES)).drop("fold", "target")


def feature_set(version, spark, sf):
    """A numbered feature set end to end, from raw tables."""
    df = fx.campaign(spark, sf).drop("target_planted").withColumnRenamed("target", "y")
    train = df.where("split = 'train'").drop("split")
    test = df.where("split = 'test'").drop("split", "y")
    return rounded(recipes.feature_set(train, test, version, fx.original(spark, sf), ROLES))


def feature_set_features(version, spark, sf):
    return feature_set(version, spark, sf).drop("fold", "target")


QUERIES = {f"recipe_pr{v}": partial(preprocessed, v) for v in recipes.PREPROCESSING}
QUERIES |= {f"recipe_fe{r}": partial(featured, r) for r in recipes.FEATURES}
QUERIES["feature_set"] = partial(feature_set, 4)
QUERIES |= {f"feature_set_{v}": partial(feature_set_features, v) for v in recipes.FEATURE_SETS}

C = fx.CAMPAIGN
LABEL = "case when split='train' then target end as target"


def _r(names, view="", alias=None):
    return ", ".join(f'round({view}"{n}",6) as "{n}"' for n in names)


def power_ctes(tail):
    """CTE ``powered``: flags, limits, most likely exponents, transform and scaling."""
    if tail is None:
        clipped = "clipped as (select * from campaign)"
    else:
        bounds = ", ".join(
            f"quantile_cont({c},{tail}) {c}_lo, quantile_cont({c},{1 - tail}) {c}_hi" for c in POWER
        )
        cells = ", ".join(f"least(greatest({c},{c}_lo),{c}_hi) as {c}" for c in POWER)
        names = ", ".join(f"{c}_lo, {c}_hi" for c in POWER)
        clipped = f"""q as (select {bounds} from campaign), clipped as (select * exclude ({names})
            replace ({cells}) from campaign cross join q)"""
    exponents = ", ".join(fq.yj_ctes("clipped", c, 6) for c in POWER)
    joins = "".join(f" cross join (select lam lam_{c} from yj_{c})" for c in POWER)
    cells = ", ".join(f"{fq.yj_sql(c, f'lam_{c}')} as {c}" for c in POWER)
    drop = ", ".join(f"lam_{c}" for c in POWER)
    return f"""{clipped}, {exponents}, raised as (select * exclude ({drop}) replace ({cells}) from clipped{joins}),
      powered as (select * replace ({', '.join(f'{fq.scaled(c, "raised")} as {c}' for c in POWER)},
        cast(n_items > 0 as int) as n_items, cast(ship_gap <> -1 as int) as ship_gap) from raised)"""


def _power(tail):
    return f"""with {C}, {power_ctes(tail)} select id, round(price,6) as price, round(balance,6) as balance,
        n_items, round(qty,6) as qty, ship_gap, status, segment, nation, returned, split, {LABEL} from powered"""


def _scaled_view(view, nums, name="s"):
    return f"{name} as (select * replace ({', '.join(f'{fq.scaled(c, view)} as {c}' for c in nums)}) from {view})"


HOT = {
    "status": fq.STATUSES, "segment": fq.SEGMENTS,
    "nation": sorted(f"NATION_{i}" for i in range(25)), "returned": ["no", "yes"],
}


def _hot_names(levels):
    return [f"{c}_{v}" for c, vs in levels.items() for v in vs]


def _fe2(view="campaign", ctes=""):
    return f"""with {C}, {ctes}{_scaled_view(view, NUM)} select id, split, {_r(NUM)}, {fq.hot_picks(HOT, 'double')} from s"""


def _fe4(view="campaign", ctes=""):
    return f"with {C}, {ctes}{_scaled_view(view, NUM)}, {fq.rank_ctes('campaign', TEXT)} " + _codes(
        "s", ", ".join(f"round({c},6) as {c}" for c in NUM)
    )


def _fe5(view="campaign", ctes=""):
    hot = HOT
    factors = _hot_names(hot) + NUM
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1:]]

    def cell(a, b):
        if b in NUM:
            return f'round("{a}"*"{b}",6) as "{a}_{b}"'
        return f'"{a}"*"{b}" as "{a}_{b}"'

    return f"""with {C}, {ctes}{_scaled_view(view, NUM)}, h as (select id, split, {', '.join(NUM)},
        {fq.hot_picks(hot, 'int')} from s) select id, split, {_r(NUM)},
        {', '.join(f'"{n}"' for n in _hot_names(hot))}, {', '.join(cell(a, b) for a, b in pairs)} from h"""


def _fe3(view="campaign", ctes=""):
    te = ["segment", "status"]
    cells = ", ".join(f"{c}_te" for c in te)
    return f"""with {C}, {ctes}{fq.te_ctes('campaign', {c: c for c in te})},
        m as (select b.id, split, {', '.join(NUM)}, {cells}, {fq.hot_picks({'returned': ['yes']}, 'double')}
          from {view} b join te on te.id=b.id)
        select id, split, {', '.join(f'round({fq.scaled(c, "m")},6) as {c}' for c in [*NUM, 'segment_te', 'status_te'])},
        returned_yes from m"""


def _fe6():
    cols = {"balance": 0, "qty": 0, "ship_gap": -1, "price": None}
    bins = fq.bins_sql(C, "campaign", cols)
    head, tail = bins.split(" select b.id,", 1)
    return f"""{head}, binned as (select b.id,{tail}), {fq.rank_ctes('campaign', TEXT)}
        select b.id, b.split, cast(b.n_items as varchar) as n_items, binned.price, binned.balance, binned.qty,
        binned.ship_gap, {fq.rank_picks(TEXT)} from campaign b join binned on binned.id=b.id{fq.rank_joins(TEXT)}"""


def _fe8():
    order = [*NUM, *TEXT]
    crosses = [n for *_, n in fq.cross_names(order)]
    names = [*TEXT, *crosses]
    cells = ", ".join(f"round({n}_te,6) as {n}_te" for n in names)
    nums = ", ".join(f"c.{n}" if n in ("n_items", "ship_gap") else f"round(c.{n},6) as {n}" for n in NUM)
    cte = fq.crosses_cte("campaign", order, extra="id, split, target, " + ", ".join(TEXT))
    return f"""with {C}, {cte}, {fq.te_ctes('crossed', {n: n for n in names})}
        select c.id, c.split, {nums}, {cells} from te join campaign c on c.id=te.id"""


def _codes(view, nums):
    return f"""select b.id, b.split, {nums}, {fq.rank_picks(TEXT)} from {view} b{fq.rank_joins(TEXT)}"""


SQL = {
    "recipe_pr1": f"""with {C} select id, round(price,6) as price, round(balance,6) as balance, n_items,
        round(qty,6) as qty, ship_gap, status, segment, nation, returned, {LABEL}, split from campaign""",
    "recipe_pr2": f"""with {C}, {fx.ORIGINAL} select id, round(price,6) as price, round(balance,6) as balance, n_items,
          round(qty,6) as qty, ship_gap, status, segment, nation, returned, cast({LABEL.replace(' as target', '')} as bigint) as target, split
          from campaign
        union all select id, round(price,6), round(balance,6), n_items, null, null, status, segment, null, null,
          cast(y='yes' as bigint), 'train' from original""",
    "recipe_pr3": _power(None),
    "recipe_pr4": _power(0.01),
    "recipe_pr5": _power(0.05),
    "recipe_fe1": f"with {C}, {fq.rank_ctes('campaign', TEXT)} "
    + _codes("campaign", "round(price,6) as price, round(balance,6) as balance, n_items, round(qty,6) as qty, ship_gap"),
    "recipe_fe2": _fe2(),
    "recipe_fe3": _fe3(),
    "recipe_fe4": _fe4(),
    "recipe_fe5": _fe5(),
    "recipe_fe6": _fe6(),
    "recipe_fe7": f"""with {C}, {fq.te_ctes('campaign', {c: c for c in TEXT})} select c.id, c.split,
        round(price,6) as price, round(balance,6) as balance, n_items, round(qty,6) as qty, ship_gap,
        {', '.join(f'round({c}_te,6) as {c}_te' for c in TEXT)} from te join campaign c on c.id=te.id""",
    "recipe_fe8": _fe8(),
    "feature_set": f"""with {C}, {power_ctes(None)}, {_scaled_view('powered', NUM)}
        select id, split, {LABEL}, {_r(NUM)}, {fq.hot_picks(HOT, 'double')} from s""",
}
SQL |= {f"feature_set_{v}": SQL[f"recipe_fe{r}"] for v, (p, r) in recipes.FEATURE_SETS.items() if p == 1}
_TAILS = {3: None, 4: 0.01, 5: 0.05}
SQL |= {
    f"feature_set_{v}": {2: _fe2, 3: _fe3, 4: _fe4, 5: _fe5}[r]("powered", power_ctes(_TAILS[p]) + ", ")
    for v, (p, r) in recipes.FEATURE_SETS.items() if p in _TAILS
}
# set 3 codes the levels of the original rows as well
SQL["feature_set_3"] = f"""with {C}, {fx.ORIGINAL}, wide as (
      select id, price, balance, n_items, qty, ship_gap, status, segment, nation, returned, split from campaign
      union all select id, price, balance, n_items, null, null, status, segment, null, null, 'train' from original),
      {fq.rank_ctes('wide', TEXT)} """ + _codes(
    "wide", "round(price,6) as price, round(balance,6) as balance, n_items, round(qty,6) as qty, ship_gap"
)
