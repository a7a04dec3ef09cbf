"""Registered queries: table profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from rowloom.operators import categories, profile, quantiles
from rowloom.session import fresh_path
from rowloom.sources import sketches

SHARES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
NUMERIC = ["balance", "n_items", "price", "qty", "ship_gap"]


def _rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def group_mean(spark, sf):
    return fx.campaign_null(spark, sf).where("segment is not null").groupBy("segment").agg(
        F.round(F.avg("target"), 6).alias("target_mean")
    )


def nunique_all(spark, sf):
    df = fx.campaign_null(spark, sf)
    return categories.distinct_counts(df, ["segment", "balance", "status", "split"])


#: sketches of this size, so that ids go beyond what is counted exactly
SKETCHED, SKETCH_K = ["segment", "balance", "id", "status", "split"], 12


def _sketch_store(spark, sf, rows):
    """Sketches of a table that came in a slice for each split."""
    store = sketches.SketchStore(spark, fresh_path(spark, "sketches"), SKETCH_K)
    store.add(rows, SKETCHED, by="split")
    return store


def nunique_sketch(spark, sf):
    """Distinct counts from sketches stored per slice: rows and NULLs are exact, counts are held against exact ones,
    and the sketch of all rows at once must say the same."""
    rows = fx.campaign_null(spark, sf)
    found = _sketch_store(spark, sf, rows).estimates()
    whole = sketches.estimates(sketches.column_sketches(rows, SKETCHED, SKETCH_K), SKETCH_K).select("col", F.col("n_distinct").alias("at_once"))
    both = found.join(whole, "col").join(categories.distinct_counts(rows, SKETCHED).withColumnRenamed("n_distinct", "true_count"), "col")
    return both.select(
        "col", "rows", "nulls", (F.col("n_distinct") == F.col("at_once")).alias("same_merged"),
        F.col("true_count").between(F.col("low"), F.col("high")).alias("within_bounds"),
        F.when(F.col("exact"), F.col("n_distinct")).alias("n_distinct"), "exact",
    )


def level_overlap_sketch(spark, sf):
    """Levels of test rows that train rows have, and those they have not, from the slices' sketches."""
    rows = fx.campaign_null(spark, sf).select("*", F.concat_ws("-", "segment", "status").alias("both"))
    store = sketches.SketchStore(spark, fresh_path(spark, "sketches"), log_k=20)
    store.add(rows, ["segment", "status", "both", "balance"], by="split")
    return store.overlap(["train"], ["test"])


def category_freq(spark, sf):
    return profile.category_frequency(fx.campaign_null(spark, sf), ["segment", "status"])


def category_freq_docs(spark, sf):
    return profile.category_frequency(fx.docs_labeled(spark, sf), ["lang", "source"])


def missing_info(spark, sf):
    return profile.missing_report(fx.campaign_null(spark, sf))


def num_summary(spark, sf):
    out = profile.numeric_summary(fx.campaign_null(spark, sf).join(
        fx.campaign(spark, sf).select("id", "price", "qty"), "id"), ["balance", "price", "qty"])
    return out.select(
        "column", "count", *[F.round(c, 5).alias(c) for c in out.columns if c not in ("column", "count")]
    )


def num_summary_bracketed(spark, sf):
    """The same summary by the way large columns take."""
    out = profile.numeric_summary(fx.campaign(spark, sf), ["balance", "n_items", "price"], small_rows=1)
    return out.select(
        "column", "count", *[F.round(c, 5).alias(c) for c in out.columns if c not in ("column", "count")]
    )


def quantiles_exact(spark, sf):
    found = quantiles.column_quantiles(fx.campaign(spark, sf), {c: SHARES for c in NUMERIC})
    rows = [(c, s, float(v)) for c in NUMERIC for s, v in zip(SHARES, found[c])]
    return spark.createDataFrame(rows, "column string, share double, value double").withColumn(
        "value", F.round("value", 5)
    )


def histogram(spark, sf):
    out = profile.histogram(fx.campaign(spark, sf), ["price", "balance", "qty"], 30)
    return _rounded(out, 5, "low", "high")


def kde_by_category(spark, sf):
    out = profile.density_by_category(fx.campaign(spark, sf), "segment", "balance")
    return out.select(
        "level", "i", F.round("x", 5).alias("x"), F.round(F.col("density") * 1000, 6).alias("density")
    )


def box_stats(spark, sf):
    return _rounded(
        profile.box_statistics(fx.campaign_null(spark, sf), "segment", "balance"), 6, "q1", "median", "q3"
    )


def box_stats_bracketed(spark, sf):
    out = profile.box_statistics(fx.campaign(spark, sf), "nation", "price", small_rows=100)
    return _rounded(out, 6, "q1", "median", "q3")


def corr_matrix(spark, sf):
    return _rounded(profile.correlations(fx.campaign(spark, sf), NUMERIC), 9, "corr")


def corr_matrix_gaps(spark, sf):
    """NaN is missing, and a constant column has no correlation."""
    df = fx.campaign(spark, sf).select(
        "id", F.when(F.col("id") % 13 == 0, float("nan")).otherwise(F.col("balance")).alias("balance"), "price",
        F.when(F.col("id") % 17 != 0, F.col("qty")).alias("qty"), F.lit(0.1).alias("same"),
    )
    return _rounded(profile.correlations(df, ["balance", "price", "qty", "same"]), 9, "corr")


def corr_matrix_wide(spark, sf):
    """All numeric columns of lineitem and some products: the many-columns way."""
    df = fx.table(spark, sf, "lineitem")
    base = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    df = df.select(
        *base,
        *[(F.col(a) * F.col(b)).alias(f"{a}__{b}") for a in base[:3] for b in base[:3]],
    )
    return _rounded(profile.correlations(df, df.columns), 7, "corr")


def oof_corr(spark, sf):
    wide = fx.preds(spark, sf).where("split = 'train'").groupBy("id").pivot(
        "model_id", ["m1", "m2", "m3"]
    ).agg(F.first("pred"))
    return _rounded(profile.correlations(wide, ["m1", "m2", "m3"]), 9, "corr")


QUERIES = {
    f.__name__: f
    for f in (
        group_mean, nunique_all, nunique_sketch, level_overlap_sketch, category_freq, category_freq_docs, missing_info, num_summary,
        num_summary_bracketed, histogram, kde_by_category, box_stats, box_stats_bracketed,
        corr_matrix, corr_matrix_gaps, corr_matrix_wide, oof_corr,
    )
}
QUERIES["quantiles"] = quantiles_exact

C, N = fx.CAMPAIGN, fx.CAMPAIGN_NULL


def _freq(source, view, cols):
    parts = " union all ".join(f"select '{c}' as col, {c} as level from {view}" for c in cols)
    return f"""with {source}, l as ({parts}),
      c as (select col, level, count(*) n from l group by col, level),
      t as (select col, count(*) total from l group by col)
      select c.col, c.level, cast(n as bigint) as "count", round(cast(n as double)/total*100, 2) as ratio
      from c join t on t.col=c.col"""


def _summary(source, views):
    parts = []
    for c, view in views.items():
        qs = ", ".join(
            f"round(quantile_cont({c}, {s}), 5) as p{round(s * 100):02d}" for s in SHARES
        )
        parts.append(
            f"""select '{c}' as "column", cast(count({c}) as bigint) as "count", round(avg({c}),5) as mean,
            round(stddev_samp({c}),5) as std, round(cast(min({c}) as double),5) as "min", {qs},
            round(cast(max({c}) as double),5) as "max" from {view}"""
        )
    return f"with {source} " + " union all ".join(parts)


def _hist(c):
    return f"""select '{c}' as "column", b.i as bin, round(lo+b.i*(hi-lo)/30,5) as low,
      round(lo+(b.i+1)*(hi-lo)/30,5) as high, cast(coalesce(n,0) as bigint) as "count"
      from (select min({c}) lo, max({c}) hi from campaign) s
      cross join (select cast(unnest(range(0,30)) as int) i) b
      left join (select cast(least(floor(({c}-lo)/(hi-lo)*30),29) as int) i, count(*) n
        from campaign cross join (select min({c}) lo, max({c}) hi from campaign) group by 1) k on k.i=b.i"""


def _corr(source, view, cols, digits):
    parts = [
        f"select '{a}' as col_a, '{b}' as col_b, round(corr({x}, {y}), {digits}) as corr from {view}"
        for a, x in cols.items()
        for b, y in cols.items()
    ]
    return (f"with {source} " if source else "") + " union all ".join(parts)


def _box(source, view, cat, val):
    return f"""with {source}, base as (select {cat} g, {val} v from {view} where {cat} is not null and {val} is not null),
      q as (select g, quantile_cont(v,0.25) q1, quantile_cont(v,0.5) med, quantile_cont(v,0.75) q3 from base group by g)
      select b.g as {cat}, round(max(q1),6) as q1, round(max(med),6) as median, round(max(q3),6) as q3,
        min(case when v>=q1-1.5*(q3-q1) then v end) as low, max(case when v<=q3+1.5*(q3-q1) then v end) as high
      from base b join q on q.g=b.g group by b.g"""


_BASE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
_WIDE = {c: c for c in _BASE} | {f"{a}__{b}": f"{a}*{b}" for a in _BASE[:3] for b in _BASE[:3]}

SQL = {
    "group_mean": f"""with {N} select segment, round(avg(target),6) as target_mean from campaign_null
        where segment is not null group by segment""",
    "nunique_all": f"with {N} "
    + " union all ".join(
        f"select '{c}' as col, cast(count(distinct {c}) as bigint) as n_distinct from campaign_null"
        for c in ("segment", "balance", "status", "split")
    ),
    "nunique_sketch": f"with {N}, e as ("
    + " union all ".join(
        f"select '{c}' as col, cast(count(*) as bigint) as rows, cast(count(*)-count({c}) as bigint) as nulls, "
        f"cast(count(distinct {c}) as bigint) as n from campaign_null"
        for c in SKETCHED
    )
    + ") select col, rows, nulls, true as same_merged, true as within_bounds, "
    + f"case when n < {2**SKETCH_K} then n end as n_distinct, n < {2**SKETCH_K} as exact from e",
    "level_overlap_sketch": f"with {N}, r as (select *, concat_ws('-', segment, status) as \"both\" from campaign_null) "
    + " union all ".join(
        f"""select '{c}' as col, cast(a as bigint) as left_levels, cast(b as bigint) as right_levels,
        cast(s as bigint) as shared, cast(b-s as bigint) as unseen from (select
          count(distinct case when tr then l end) a, count(distinct case when te then l end) b,
          count(distinct case when tr and te then l end) s
        from (select "{c}" l, bool_or(split='train') tr, bool_or(split='test') te from r where "{c}" is not null group by 1))"""
        for c in ("segment", "status", "both", "balance")
    ),
    "category_freq": _freq(N, "campaign_null", ["segment", "status"]),
    "category_freq_docs": _freq(fx.DOCS_LABELED, "docs_labeled", ["lang", "source"]),
    "missing_info": f"""with {N}, m as (select count(*) n, count(*)-count(segment) a, count(*)-count(balance) b
          from campaign_null)
        select 'segment' as "column", cast(a as bigint) as missing_count,
          printf('%.2f%%', 100.0*a/n) as missing_ratio, 'string' as dtype, 'cat' as family from m
        union all select 'balance', cast(b as bigint), printf('%.2f%%', 100.0*b/n), 'double', 'num' from m""",
    "num_summary": _summary(N, {"balance": "campaign_null", "price": "campaign", "qty": "campaign"}),
    "num_summary_bracketed": _summary(C, {c: "campaign" for c in ("balance", "n_items", "price")}),
    "quantiles": f"with {C} "
    + " union all ".join(
        f"""select '{c}' as "column", cast({s} as double) as share,
        round(quantile_cont({c}, {s}),5) as value from campaign"""
        for c in NUMERIC
        for s in SHARES
    ),
    "histogram": f"with {C} " + " union all ".join(_hist(c) for c in ("price", "balance", "qty")),
    "kde_by_category": f"""with {C}, st as (select segment, count(*) n,
          stddev_samp(balance)*power(count(*),-0.2) h, min(balance) mn, max(balance) mx
          from campaign group by segment),
        g as (select segment, n, h, i, mn-3*h+(mx-mn+6*h)*i/199.0 x
          from st cross join (select unnest(range(0,200)) i) k)
        select g.segment as level, cast(g.i as int) as i, round(max(g.x),5) as x,
          round(sum(exp(-0.5*power((g.x-b.balance)/g.h,2)))/(max(g.n)*max(g.h)*sqrt(2*pi()))*1000,6) as density
        from g join campaign b on b.segment=g.segment group by g.segment, g.i""",
    "box_stats": _box(N, "campaign_null", "segment", "balance"),
    "box_stats_bracketed": _box(C, "campaign", "nation", "price"),
    "corr_matrix": _corr(C, "campaign", {c: c for c in NUMERIC}, 9),
    "corr_matrix_gaps": _corr(
        f"{C}, gaps as (select case when id % 13 <> 0 then balance end as balance, price, case when id % 17 <> 0 then qty end as qty, 0.1 as same from campaign)",
        "gaps", {"balance": "balance", "price": "price", "qty": "qty", "same": "cast(null as double)"}, 9,
    ),
    "corr_matrix_wide": _corr("", "lineitem", _WIDE, 7),
    "oof_corr": _corr(
        fx.PREDS
        + """, w as (select id, max(case when model_id='m1' then pred end) m1,
          max(case when model_id='m2' then pred end) m2, max(case when model_id='m3' then pred end) m3
          from preds where split='train' group by id)""",
        "w", {c: c for c in ("m1", "m2", "m3")}, 9,
    ),
}
