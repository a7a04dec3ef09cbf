"""Summaries of a table: missing values, frequencies, quantiles, densities, correlations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.scalars import percent_text, ratio
from rowloom.layout import DEFAULT, Layout
from rowloom.operators.categories import level_counts
from rowloom.operators.columns import categorical_columns, col, numeric_columns
from rowloom.operators.joins import lookup
from rowloom.operators.quantiles import SMALL_ROWS, column_quantiles, group_quantiles
from rowloom.session import settle

SUMMARY_SHARES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def _missing(df: DataFrame, name: str) -> Column:
    x = col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return x.isNull() | F.isnan(x)
    return x.isNull()


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing values: count, share as text, type, and whether categorical."""
    names = df.columns
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(_missing(df, c)).alias(f"m{i}") for i, c in enumerate(names)],
    )
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"m{i}").alias("missing_count"),
            percent_text(ratio(F.col(f"m{i}"), F.col("rows"))).alias("missing_ratio"),
            F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
            F.lit("cat" if isinstance(df.schema[c].dataType, T.StringType) else "num").alias("family"),
        )
        for i, c in enumerate(names)
    ]
    return (
        row.select(F.explode(F.array(*cells)).alias("c"))
        .select("c.*")
        .where("missing_count > 0")
        .orderBy("family", F.desc("missing_count"), "column")
    )


def category_frequency(
    df: DataFrame, cols: Sequence[str] | None = None, layout: Layout = DEFAULT
) -> DataFrame:
    """Rows and share in percent per level, the missing level included, most frequent first."""
    cols = list(cols) if cols is not None else categorical_columns(df, layout)
    counts = level_counts(df, cols)
    totals = counts.groupBy("col").agg(F.sum("rows").alias("total"))
    # one row per column name, so the broadcast is as small as the column list
    return (
        counts.join(F.broadcast(totals), "col")
        .select(
            "col", "level", F.col("rows").alias("count"),
            F.round(ratio(F.col("rows"), F.col("total")) * 100, 2).alias("ratio"),
        )
        .orderBy("col", F.desc("count"), "level")
    )


def numeric_summary(
    df: DataFrame, cols: Sequence[str] | None = None, layout: Layout = DEFAULT,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Count, mean, sample deviation, extremes and quantiles per numeric column."""
    cols = list(cols) if cols is not None else sorted(numeric_columns(df, layout))
    # quantiles and the other statistics read the same numbers
    df = settle(df.select(*[col(c) for c in cols]), "numbers")
    found = column_quantiles(df, {c: SUMMARY_SHARES for c in cols}, small_rows=small_rows)
    aggs, cells = [], []
    for i, c in enumerate(cols):
        x = F.when(~_missing(df, c), col(c).cast("double"))
        stats = {"count": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)}
        aggs += [v.alias(f"{k}_{i}") for k, v in stats.items()]
        quantiles = found[c] or [None] * len(SUMMARY_SHARES)
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                *[F.col(f"{k}_{i}").alias(k) for k in ("count", "mean", "std", "min")],
                *[
                    F.lit(q).cast("double").alias(f"p{round(s * 100):02d}")
                    for s, q in zip(SUMMARY_SHARES, quantiles)
                ],
                F.col(f"max_{i}").alias("max"),
            )
        )
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width counts ``(column, bin, low, high, count)``; empty bins are listed too."""
    cols = list(cols)
    row = df.agg(
        *[F.min(col(c).cast("double")).alias(f"lo{i}") for i, c in enumerate(cols)],
        *[F.max(col(c).cast("double")).alias(f"hi{i}") for i, c in enumerate(cols)],
    ).first()
    spans = {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)}
    spans = {c: s for c, s in spans.items() if s[0] is not None}
    # a single value gets a span of one around it
    spans = {c: (a, b) if b > a else (a - 0.5, b + 0.5) for c, (a, b) in spans.items()}
    frame = df.sparkSession.createDataFrame(
        [(c, a, b) for c, (a, b) in spans.items()], "column string, lo double, hi double"
    )
    cells = []
    for c, (a, b) in spans.items():
        at = F.least(F.floor((col(c).cast("double") - a) / F.lit(b - a) * bins), F.lit(bins - 1))
        cells.append(F.struct(F.lit(c).alias("column"), at.cast("int").alias("bin")))
    counted = (
        df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("bin is not null")
        .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count"))
    )
    grid = frame.select("column", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counted, ["column", "bin"], "left").select(
        "column", "bin",
        (F.col("lo") + F.col("bin") * width).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
    )


def density_by_category(
    df: DataFrame, category: str, value: str, points: int = 200, cut: float = 3.0,
    layout: Layout = DEFAULT, bin_width: float | None = None,
) -> DataFrame:
    """Gaussian kernel density of ``value`` per level, each level summing to one.

    With ``bin_width``, a share of the bandwidth, rows are first counted in bins of that width,
    each split between the two bins it lies between; the kernel then meets bins instead of rows. The error is
    at most bin_width squared / 8 of a kernel's height: below 1e-6 of it for 1/400.

    Bandwidth by Scott's rule; the grid reaches ``cut`` bandwidths beyond the data.
    Every row adds to ``points`` sums inside its task, so what is shuffled is one
    partial sum per level, grid point and task.
    """
    x = col(value).cast("double")
    rows = df.where(col(category).isNotNull() & x.isNotNull()).select(
        col(category).alias("level"), x.alias("x"), col(layout.id).alias("id")
    )
    stats = rows.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"),
        (F.stddev_samp("x") * F.pow(F.count(F.lit(1)), F.lit(-0.2))).alias("h"),
        F.min("x").alias("lo"), F.max("x").alias("hi"),
    ).where("n > 1 and h > 0")
    placed = lookup(rows, stats, ["level"], ["n", "h", "lo", "hi"], "n", F.col("id"))
    placed = placed.where("h is not null").select("level", "x", "n", "h", "lo", "hi")
    if bin_width is not None:
        return _binned_density(placed, points, cut, bin_width)

    def partial(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        steps = np.arange(points) / (points - 1.0)
        sums: dict = {}
        for batch in batches:
            for level, part in batch.groupby("level", sort=False):
                n, h, lo, hi = part[["n", "h", "lo", "hi"]].iloc[0]
                grid = (lo - cut * h) + (hi - lo + 2 * cut * h) * steps
                if level not in sums:
                    sums[level] = (np.zeros(points), grid, n, h)
                values = part["x"].to_numpy()
                for start in range(0, len(values), 2048):
                    z = (grid[:, None] - values[None, start:start + 2048]) / h
                    sums[level][0][:] += np.exp(-0.5 * z * z).sum(axis=1)
            if len(sums) > 2000:
                yield from flush(pd, np, sums)
                sums = {}
        yield from flush(pd, np, sums)

    def flush(pd, np, sums):
        for level, (total, grid, n, h) in sums.items():
            yield pd.DataFrame(
                {"level": level, "i": np.arange(len(total)), "x": grid, "n": int(n), "h": h, "s": total}
            )

    parts = placed.mapInPandas(
        partial, "level string, i int, x double, n long, h double, s double"
    )
    return parts.groupBy("level", "i").agg(
        F.first("x").alias("x"),
        (F.sum("s") / (F.first("n") * F.first("h") * (2 * 3.141592653589793) ** 0.5)).alias("density"),
    )


def _binned_density(rows: DataFrame, points: int, cut: float, bin_width: float) -> DataFrame:
    """Densities from counts per bin; rows only ever add to counts, in the tasks that read them."""
    at = (F.col("x") - F.col("lo")) / (F.col("h") * bin_width)
    below = F.floor(at)
    cells = F.explode(F.array(
        F.struct(below.alias("k"), (1 - (at - below)).alias("w")), F.struct((below + 1).alias("k"), (at - below).alias("w"))
    ))
    binned = rows.select("level", "n", "h", "lo", "hi", cells.alias("c")).where("c.w > 0")
    binned = binned.groupBy("level", "n", "h", "lo", "hi", F.col("c.k").alias("k")).agg(F.sum("c.w").alias("w"))

    def convolved(part):
        import numpy as np
        import pandas as pd

        n, h, lo, hi = part[["n", "h", "lo", "hi"]].iloc[0]
        grid = (lo - cut * h) + (hi - lo + 2 * cut * h) * (np.arange(points) / (points - 1.0))
        centres, weights, total = lo + part["k"].to_numpy() * h * bin_width, part["w"].to_numpy(), np.zeros(points)
        for start in range(0, len(weights), 2048):
            z = (grid[:, None] - centres[None, start : start + 2048]) / h
            total += np.exp(-0.5 * z * z) @ weights[start : start + 2048]
        return pd.DataFrame({"level": part["level"].iloc[0], "i": np.arange(points), "x": grid, "density": total / (n * h * (2 * np.pi) ** 0.5)})

    # a level's bins: the range in bandwidths over bin_width, however many rows it has
    return binned.groupBy("level").applyInPandas(convolved, "level string, i int, x double, density double")


def box_statistics(
    df: DataFrame, category: str, value: str, layout: Layout = DEFAULT,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Quartiles per level and whiskers at the furthest values within 1.5 spreads of the box."""
    boxes = group_quantiles(
        df, category, value, [0.25, 0.5, 0.75], small_rows=small_rows, spread_by=col(layout.id)
    )
    q = [F.get("q", F.lit(i)) for i in range(3)]
    boxes = boxes.select(
        category, "n", q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3")
    )
    x = col(value).cast("double")
    rows = df.where(col(category).isNotNull() & x.isNotNull()).select(
        col(category), x.alias("_x"), col(layout.id).alias("_id")
    )
    placed = lookup(rows, boxes, [category], ["q1", "median", "q3"], "n", F.col("_id"))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return placed.groupBy(category).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(F.col("_x") >= F.col("q1") - reach, F.col("_x"))).alias("low"),
        F.max(F.when(F.col("_x") <= F.col("q3") + reach, F.col("_x"))).alias("high"),
    )


# ---------------------------------------------------------------- correlation

def correlations(
    df: DataFrame, cols: Sequence[str] | None = None, layout: Layout = DEFAULT
) -> DataFrame:
    """Pearson correlation of every two numeric columns over the rows that have both.

    Long form ``(col_a, col_b, corr)``, both orders and the diagonal. NaN is missing, like
    NULL; a pair in which one column does not vary has NULL. Tasks reduce their rows to
    cross-product matrices, and Spark adds these.
    """
    cols = list(cols) if cols is not None else numeric_columns(df, layout)
    upper = _corr_upper(df, cols)
    names = F.array(*[F.lit(c) for c in cols])
    both = F.when(
        F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")))
    ).otherwise(
        F.array(
            F.struct(F.col("i").alias("a"), F.col("j").alias("b")),
            F.struct(F.col("j").alias("a"), F.col("i").alias("b")),
        )
    )
    return upper.select(F.explode(both).alias("p"), "corr").select(
        F.get(names, F.col("p.a")).alias("col_a"), F.get(names, F.col("p.b")).alias("col_b"), "corr"
    )


def _corr_upper(df, cols):
    x = [F.when(~F.isnan(col(c).cast("double")), col(c).cast("double")) for c in cols]
    means = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)]).first()
    centre = [float(means[f"m{i}"] or 0.0) for i in range(len(cols))]
    slim = df.select(*[v.alias(f"x{i}") for i, v in enumerate(x)])

    def partial(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        p = len(centre)
        sums = np.zeros((5, p, p))
        for batch in batches:
            x = batch.to_numpy(dtype="float64", na_value=np.nan) - np.array(centre)
            seen = (~np.isnan(x)).astype("float64")
            x = np.where(seen > 0, x, 0.0)
            sq = x * x
            sums[0] += seen.T @ seen
            sums[1] += x.T @ seen
            sums[2] += seen.T @ x
            sums[3] += sq.T @ seen
            sums[4] += x.T @ x
        i, j = np.triu_indices(p)
        yield pd.DataFrame(
            {
                "i": i, "j": j, "n": sums[0][i, j], "sx": sums[1][i, j], "sy": sums[2][i, j],
                "sxx": sums[3][i, j], "syy": sums[3].T[i, j], "sxy": sums[4][i, j],
            }
        )

    fields = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    schema = "i int, j int, " + ", ".join(f"{f} double" for f in fields)
    total = slim.mapInPandas(partial, schema).groupBy("i", "j").agg(*[F.sum(f).alias(f) for f in fields])
    cov = F.expr("sxy - sx * sy / nullif(n, 0)")
    # what a column without spread has left is the rounding of its centre
    noise = F.array(*[F.lit((1e-12 * abs(c)) ** 2) for c in centre])

    def varies(own, total_, at):
        value = F.expr(f"{own} - {total_} * {total_} / nullif(n, 0)")
        return F.when(value > F.col("n") * F.get(noise, F.col(at)), value)

    spread = F.sqrt(varies("sxx", "sx", "i") * varies("syy", "sy", "j"))
    return total.select("i", "j", ratio(cov, spread).alias("corr"))
