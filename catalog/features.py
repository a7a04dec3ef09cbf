"""Registered queries: folds, encoders and numeric transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from rowloom.functions.scalars import yeo_johnson
from rowloom.operators import categories as cat
from rowloom.operators import folds
from rowloom.operators import numeric as num
from rowloom.operators.columns import q
from rowloom.operators.crosses import CrossMeans
from rowloom.session import release, settle

TEXT = ["status", "segment", "nation", "returned"]
SENTINELS = {"balance": 0, "n_items": 0, "qty": 0, "ship_gap": -1}


def rounded(df, names, digits=6):
    return df.selectExpr(
        *[f"round({q(c)}, {digits}) as {q(c)}" if c in names else q(c) for c in df.columns]
    )


def stratified_kfold(spark, sf):
    train = fx.campaign(spark, sf).where("split = 'train'").select("id", "target")
    return folds.stratified_folds(train)


def kfold(spark, sf):
    train = fx.campaign(spark, sf).where("split = 'train'").select("id", "price")
    return folds.plain_folds(train)


def stratified_kfold_multiclass(spark, sf):
    """Ten labels, every one split evenly."""
    df = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("target"))
    return folds.stratified_folds(df)


def label_encode(spark, sf):
    df = fx.campaign(spark, sf).select("id", *TEXT)
    return cat.LabelCodes.fit(df, TEXT).transform(df)


def label_encode_null(spark, sf):
    """A missing value gets the code after the last level."""
    df = fx.campaign_null(spark, sf).select("id", "segment", "status")
    return cat.LabelCodes.fit(df, ["segment", "status"]).transform(df)


def label_encode_many(spark, sf):
    """A key with as many levels as customers, numbered by the way large columns take."""
    df = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment")
    return cat.LabelCodes.fit(df, ["c_name", "c_mktsegment"], max_rows=100).transform(df)


def one_hot(spark, sf):
    df = fx.campaign(spark, sf).select("id", "segment", "status")
    return cat.OneHot.fit(df, ["segment", "status"]).transform(df)


def one_hot_drop_first(spark, sf):
    df = fx.campaign(spark, sf).select("id", "returned", "status")
    return cat.OneHot.fit(df, ["returned", "status"], drop_first=True).transform(df)


def dummies(spark, sf):
    df = fx.campaign_null(spark, sf).select("id", "segment", "status")
    return cat.OneHot.fit(df, ["segment", "status"], kind="int", null_name="null").transform(df)


def standardize(spark, sf):
    df = fx.campaign(spark, sf).select("id", "price", "balance", "qty", F.lit(3.0).alias("flat"))
    names = ["price", "balance", "qty", "flat"]
    return rounded(num.Standardizer.fit(df, names).transform(df), names)


def standardize_train_fit(spark, sf):
    df = fx.campaign(spark, sf).select("id", "split", "price", "balance")
    names = ["price", "balance"]
    return rounded(num.Standardizer.fit(df, names, scope="train").transform(df), names)


def _encoded(df, cols, **bounds):
    tagged = settle(folds.stratified_folds(df), "folds")
    return cat.TargetEncoder.fit(tagged, cols, **bounds).transform(tagged, **bounds)


def target_encode_oof(spark, sf):
    df = fx.campaign(spark, sf).select("id", "split", "target", "segment", "nation", "status")
    out = _encoded(df, ["segment", "nation", "status"]).where("split = 'train'")
    names = ["segment_te", "nation_te", "status_te"]
    return rounded(out.select("id", *names), names)


def target_encode_test(spark, sf):
    df = fx.campaign(spark, sf).select("id", "split", "target", "segment", "nation", "status")
    out = _encoded(df, ["segment", "nation", "status"]).where("split = 'test'")
    names = ["segment_te", "nation_te", "status_te"]
    return rounded(out.select("id", *names), names)


def target_encode_null(spark, sf):
    """Missing values, and a level that no train row has."""
    out = _encoded(fx.campaign_null(spark, sf), ["segment", "status"])
    return rounded(out.select("id", "segment_te", "status_te"), ["segment_te", "status_te"])


def target_encode_shuffled(spark, sf):
    """The same by the shuffled join that columns with very many levels take."""
    out = _encoded(fx.campaign_null(spark, sf), ["segment", "status"], max_rows=0)
    return rounded(out.select("id", "segment_te", "status_te"), ["segment_te", "status_te"])


def target_encode_docs(spark, sf):
    out = _encoded(fx.docs_labeled(spark, sf), ["lang", "source"])
    return rounded(out.select("id", "lang_te", "source_te"), ["lang_te", "source_te"])


def quantile_bin(spark, sf):
    df = settle(fx.campaign(spark, sf).select("id", *SENTINELS, "price"), "campaign")
    return num.QuantileBins.fit(df, [*SENTINELS, "price"], sentinels=SENTINELS).transform(df)


def quantile_bin_bracketed(spark, sf):
    """The same with bin edges found by the way large columns take."""
    df = settle(fx.campaign(spark, sf).select("id", *SENTINELS, "price"), "campaign")
    bins = num.QuantileBins.fit(df, [*SENTINELS, "price"], sentinels=SENTINELS, small_rows=1)
    return bins.transform(df)


def interactions_numeric(spark, sf):
    df = fx.campaign(spark, sf).select("id", "status", "price", "balance", "qty")
    scaled = num.Standardizer.fit(df, ["price", "balance", "qty"]).transform(df)
    hot = cat.OneHot.fit(df, ["status"], kind="int").transform(scaled)
    factors = [c for c in hot.columns if c.startswith("status_")] + ["price", "balance", "qty"]
    out = num.add_products(hot, factors)
    real = ("price", "balance", "qty")
    return rounded(out, [c for c in out.columns if c.endswith(real)])


def cross_categorical(spark, sf):
    df = fx.campaign_null(spark, sf).join(fx.campaign(spark, sf).select("id", "nation", "n_items"), "id")
    return cat.cross_categories(df, ["segment", "status", "nation", "n_items"], ["id"])


def cross_target_encode(spark, sf):
    """All pairs of all nine columns."""
    df = settle(fx.campaign(spark, sf), "campaign", passing=True)
    tagged = settle(folds.stratified_folds(df), "folds", passing=True)
    release(df)
    fitted = CrossMeans.fit(tagged, fx.CAMPAIGN_FEATURES)
    release(tagged)
    out = fitted.transform()
    return rounded(out, [c for c in out.columns if c != "id"])


def cardinality_route(spark, sf):
    df = fx.campaign(spark, sf)
    high, low = cat.route_by_cardinality(df, TEXT, 3, exclude=["nation"])
    rows = [(c, "target") for c in high] + [(c, "one_hot") for c in low]
    return spark.createDataFrame(rows, "column string, route string")


def yeo_johnson_fit(spark, sf):
    fit = num.YeoJohnson.fit(fx.campaign(spark, sf), ["price", "balance", "qty"], digits=5)
    return spark.createDataFrame(list(fit.exponents.items()), "column string, exponent double")


def yeo_johnson_apply(spark, sf):
    df = fx.campaign(spark, sf)
    return df.select(
        "id",
        *[
            F.round(yeo_johnson(F.col(c), lam), 6).alias(f"{c}_{i}")
            for c in ("balance", "qty")
            for i, lam in enumerate((0.0, 0.3, 1.0, 2.0))
        ],
    )


def winsorize(spark, sf):
    df = settle(fx.campaign(spark, sf).select("id", "price", "balance", "qty"), "campaign")
    one = num.Winsorizer.fit(df, ["price", "balance", "qty"], 0.01).transform(df)
    five = num.Winsorizer.fit(df, ["price", "balance", "qty"], 0.05).transform(df)
    five = five.select("id", *[F.col(c).alias(f"{c}_5") for c in ("price", "balance", "qty")])
    out = one.join(five, "id")
    return rounded(out, [c for c in out.columns if c != "id"])


def residual_bins(spark, sf):
    """Classes of the gap between a label and a base prediction."""
    df = settle(fx.campaign(spark, sf).select("id", (F.col("price") / 500000 - (F.col("balance") + 1000) / 11000).alias("gap")), "campaign")
    return num.QuantileBins.fit(df, ["gap"], bins=10).transform(df, as_text=False)


QUERIES = {
    f.__name__: f
    for f in (
        stratified_kfold, kfold, stratified_kfold_multiclass, label_encode, label_encode_null,
        label_encode_many, one_hot, one_hot_drop_first, dummies, standardize, standardize_train_fit,
        target_encode_oof, target_encode_test, target_encode_null, target_encode_shuffled,
        target_encode_docs, quantile_bin, quantile_bin_bracketed, interactions_numeric,
        cross_categorical, cross_target_encode, cardinality_route, yeo_johnson_fit,
        yeo_johnson_apply, winsorize, residual_bins,
    )
}

C, N = fx.CAMPAIGN, fx.CAMPAIGN_NULL


def fold_rows(view, label="target", where="split='train'"):
    """Rows of a view with their fold."""
    return f"select *, {fx.FOLD.format(label=label)} as fold from {view} where {where}"


def te_ctes(view, columns, prefix="te", label="target"):
    """CTEs ``{prefix}`` (id, one encoding per column) over ``view(id, split, label, columns)``."""
    out = [f"{prefix}_f as ({fold_rows(view, label)})", f"{prefix}_k as (select distinct fold from {prefix}_f)"]
    joins, picks = [], []
    for i, (name, expr) in enumerate(columns.items()):
        p = f"{prefix}{i}"
        out += [
            f"{p}_lv as (select {expr} lvl, fold, sum({label}) s, count(*) n from {prefix}_f where {expr} is not null group by 1, 2)",
            f"{p}_tot as (select lvl, sum(s) ts, sum(n) tn from {p}_lv group by lvl)",
            f"""{p}_grid as (select t.lvl, k.fold, case when t.tn-coalesce(l.n,0) > 0
              then cast(t.ts-coalesce(l.s,0) as double)/(t.tn-coalesce(l.n,0)) end te
              from {p}_tot t cross join {prefix}_k k left join {p}_lv l on l.lvl=t.lvl and l.fold=k.fold)""",
            f"{p}_fill as (select fold, avg(te) fill from {p}_grid group by fold)",
            f"""{p}_all as (select f.id, g.te from {prefix}_f f left join {p}_grid g on g.lvl=f.{expr} and g.fold=f.fold
              union all select b.id, avg(coalesce(g.te, fl.fill)) te from (select * from {view} where split='test') b
              cross join {p}_fill fl left join {p}_grid g on g.lvl=b.{expr} and g.fold=fl.fold group by b.id)""",
        ]
        joins.append(f" left join {p}_all on {p}_all.id=b.id")
        picks.append(f'{p}_all.te as "{name}_te"')
    out.append(f"{prefix} as (select b.id, {', '.join(picks)} from {view} b{''.join(joins)})")
    return ",\n".join(out)


def _te(source, view, cols, where="true"):
    cells = ", ".join(f"round({c}_te,6) as {c}_te" for c in cols)
    return f"""with {source}, {te_ctes(view, {c: c for c in cols})}
        select te.id, {cells} from te join {view} v on v.id=te.id where {where}"""


def rank_ctes(view, cols):
    parts = [
        f"rk_{c} as (select {c} v, dense_rank() over (order by {c})-1 code from (select distinct {c} from {view} where {c} is not null))"
        for c in cols
    ]
    return ", ".join(parts)


def rank_joins(cols):
    return "".join(f" left join rk_{c} on rk_{c}.v=b.{c}" for c in cols)


def rank_picks(cols):
    return ", ".join(
        f"cast(coalesce(rk_{c}.code, (select count(*) from rk_{c})) as varchar) as {c}" for c in cols
    )


def _codes(source, view, cols, id_expr="b.id"):
    return f"""with {source}{',' if source else ''} {rank_ctes(view, cols)}
        select {id_expr} as id, {rank_picks(cols)} from {view} b{rank_joins(cols)}"""


def hot_picks(levels, kind, null_name="nan"):
    return ", ".join(
        f"cast(case when {c} {'is null' if v is None else f'= {chr(39)}{v}{chr(39)}'} then 1 else 0 end as {kind})"
        f' as "{c}_{null_name if v is None else v}"'
        for c, vs in levels.items()
        for v in vs
    )


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
STATUSES = ["F", "O", "P"]


def scaled(c, view="campaign", where="true"):
    m = f"(select avg({c}) from {view} where {where})"
    s = f"(select stddev_pop({c}) from {view} where {where})"
    return f"({c}-{m})/{s}"


def bin_edges_cte(name, view, c, where, bins):
    shares = ", ".join(str(i / bins) for i in range(bins + 1))
    return f"""{name} as (select distinct e from (select unnest(quantile_cont(cast({c} as double), [{shares}])) e
        from {view} where {where}))"""


def bins_sql(source, view, cols, bins=100, text=True):
    ctes, picks = [], []
    for c, s in cols.items():
        where = "true" if s is None else f"{c} <> {s}"
        ctes.append(bin_edges_cte(f"ed_{c}", view, c, where, bins))
        ctes.append(
            f"""bn_{c} as (select v, cast(greatest(count(e)-1,0) as int) code
            from (select distinct {c} v from {view} where {where}) left join ed_{c} on e < v group by v)"""
        )
        code = f"bn_{c}.code" if s is None else f"case when b.{c} = {s} then -1 else bn_{c}.code end"
        picks.append(f"cast({code} as {'varchar' if text else 'int'}) as {c}")
    joins = "".join(f" left join bn_{c} on bn_{c}.v=b.{c}" for c in cols)
    return f"with {source}, {', '.join(ctes)} select b.id, {', '.join(picks)} from {view} b{joins}"


def yj_sql(x, lam):
    """Transform with a literal or column exponent."""
    return f"""case when {x} >= 0 then case when {lam} = 0 then ln({x}+1) else (power({x}+1,{lam})-1)/nullif({lam},0) end
        else case when {lam} = 2 then -ln(1-{x}) else -(power(1-{x},2-{lam})-1)/nullif(2-{lam},0) end end"""


def yj_ctes(view, c, digits, p=None):
    """CTE ``{p}``(lam): the most likely exponent, from three narrowing grids and a parabola."""
    p = p or f"yj_{c}"
    out, centre, step = [], "(select cast(1.0 as double) c)", 0.25
    for i in range(3):
        out.append(
            f"""{p}g{i} as (select j, c+(j-16)*{step!r} lam from {centre} cross join (select unnest(range(0,33)) j))"""
        )
        out.append(
            f"""{p}l{i} as (select j, lam, -0.5*ln(var_pop({yj_sql('x', 'lam')})) + (lam-1)*avg(sign(x)*ln(1+abs(x))) ll
            from {p}g{i} cross join (select cast({c} as double) x from {view} where {c} is not null) group by j, lam)"""
        )
        centre = f"(select arg_max(lam, ll) c from {p}l{i})"
        step /= 16
    last = 0.25 / 256
    out.append(
        f"""{p} as (select round(m.lam + {last!r}*0.5*(l.ll-r.ll)/(l.ll-2*m.ll+r.ll), {digits}) lam
        from {p}l2 m join {p}l2 l on l.j=m.j-1 join {p}l2 r on r.j=m.j+1
        where m.ll = (select max(ll) from {p}l2))"""
    )
    return ", ".join(out)


def _inter():
    factors = [f"status_{v}" for v in STATUSES] + ["price", "balance", "qty"]
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1:]]

    def item(a, b):
        expr = f"{a}*{b}"
        if a.startswith("status_") and b.startswith("status_"):
            return f'{expr} as "{a}_{b}"'
        return f'round({expr},6) as "{a}_{b}"'

    cells = ", ".join(item(a, b) for a, b in pairs)
    return f"""with {C}, s as (select id, {scaled('price')} as price, {scaled('balance')} as balance,
        {scaled('qty')} as qty, {hot_picks({'status': STATUSES}, 'int')} from campaign)
        select id, round(price,6) as price, round(balance,6) as balance, round(qty,6) as qty,
        {', '.join(f'status_{v}' for v in STATUSES)}, {cells} from s"""


def cross_names(cols):
    return [(a, b, f"{a}_x_{b}") for i, a in enumerate(cols) for b in cols[i + 1:]]


def crosses_cte(view, cols, name="crossed", extra="id, split, target"):
    cells = ", ".join(
        f"cast({a} as varchar)||'_'||cast({b} as varchar) as {n}" for a, b, n in cross_names(cols)
    )
    return f"{name} as (select {extra}, {cells} from {view})"


_CROSS = fx.CAMPAIGN_FEATURES
SQL = {
    "stratified_kfold": f"""with {C} select id, target, {fx.FOLD.format(label='target')} as fold
        from campaign where split='train'""",
    "kfold": f"""with {C} select id, price,
        cast((row_number() over (order by md5('42_'||cast(id as varchar)), id)-1) % 5 as int) as fold
        from campaign where split='train'""",
    "stratified_kfold_multiclass": f"""select vec_id as id, label as target,
        {fx.FOLD.format(label='label').replace('(id as', '(vec_id as').replace(', id)', ', vec_id)')} as fold
        from embeddings""",
    "label_encode": _codes(C, "campaign", TEXT),
    "label_encode_null": _codes(N, "campaign_null", ["segment", "status"]),
    "label_encode_many": _codes("", "customer", ["c_name", "c_mktsegment"], "b.c_custkey"),
    "one_hot": f"with {C} select id, {hot_picks({'segment': SEGMENTS, 'status': STATUSES}, 'double')} from campaign",
    "one_hot_drop_first": f"""with {C} select id,
        {hot_picks({'returned': ['yes'], 'status': STATUSES[1:]}, 'double')} from campaign""",
    "dummies": f"""with {N} select id,
        {hot_picks({'segment': [*SEGMENTS, None], 'status': [*STATUSES, 'UNSEEN']}, 'int', 'null')}
        from campaign_null""",
    "standardize": f"with {C} select id, "
    + ", ".join(f"round({scaled(c)},6) as {c}" for c in ("price", "balance", "qty"))
    + ", cast(0.0 as double) as flat from campaign",
    "standardize_train_fit": f"with {C} select id, split, "
    + ", ".join(
        f"round({scaled(c, where=chr(32) + 'split=' + chr(39) + 'train' + chr(39))},6) as {c}"
        for c in ("price", "balance")
    )
    + " from campaign",
    "target_encode_oof": _te(C, "campaign", ["segment", "nation", "status"], "v.split='train'"),
    "target_encode_test": _te(C, "campaign", ["segment", "nation", "status"], "v.split='test'"),
    "target_encode_null": _te(N, "campaign_null", ["segment", "status"]),
    "target_encode_shuffled": _te(N, "campaign_null", ["segment", "status"]),
    "target_encode_docs": _te(fx.DOCS_LABELED, "docs_labeled", ["lang", "source"]),
    "quantile_bin": bins_sql(C, "campaign", {**SENTINELS, "price": None}),
    "quantile_bin_bracketed": bins_sql(C, "campaign", {**SENTINELS, "price": None}),
    "interactions_numeric": _inter(),
    "cross_categorical": f"""with {N}, w as (select n.*, c.nation, c.n_items from campaign_null n
        join campaign c on c.id=n.id), {crosses_cte('w', ['segment', 'status', 'nation', 'n_items'], extra='id')}
        select * from crossed""",
    "cross_target_encode": f"""with {C}, {crosses_cte('campaign', _CROSS)},
        {te_ctes('crossed', {n: n for *_, n in cross_names(_CROSS)})} select id, """
    + ", ".join(f"round({n}_te,6) as {n}_te" for *_, n in cross_names(_CROSS))
    + " from te",
    "cardinality_route": f"with {C} "
    + " union all ".join(
        f"""select '{c}' as "column", case when count(distinct {c}) >= 3 then 'target' else 'one_hot' end as route
        from campaign"""
        for c in ("status", "segment", "returned")
    ),
    "yeo_johnson_fit": f"with {C}, "
    + ", ".join(yj_ctes("campaign", c, 5) for c in ("price", "balance", "qty"))
    + " "
    + " union all ".join(f"""select '{c}' as "column", lam as exponent from yj_{c}""" for c in ("price", "balance", "qty")),
    "yeo_johnson_apply": f"with {C} select id, "
    + ", ".join(
        f"round({yj_sql(c, repr(lam))},6) as {c}_{i}"
        for c in ("balance", "qty")
        for i, lam in enumerate((0.0, 0.3, 1.0, 2.0))
    )
    + " from campaign",
    "winsorize": f"with {C}, q as (select "
    + ", ".join(
        f"quantile_cont({c},{t}) {c}_lo{k}, quantile_cont({c},{1 - t}) {c}_hi{k}"
        for c in ("price", "balance", "qty")
        for k, t in (("", 0.01), ("_5", 0.05))
    )
    + " from campaign) select id, "
    + ", ".join(
        f"round(least(greatest({c},{c}_lo{k}),{c}_hi{k}),6) as {c}{k}"
        for c in ("price", "balance", "qty")
        for k in ("", "_5")
    )
    + " from campaign cross join q",
    "residual_bins": bins_sql(
        C + ", r as (select id, price/500000-(balance+1000)/11000 as gap from campaign)",
        "r", {"gap": None}, bins=10, text=False,
    ),
}
