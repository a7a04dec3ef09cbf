"""Transforms of numeric columns whose parameters are learnt from the table itself."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.scalars import clip, yeo_johnson
from rowloom.layout import DEFAULT, Layout
from rowloom.operators.categories import fit_rows
from rowloom.operators.columns import col, q, sql_number
from rowloom.operators.ordering import bucket_columns
from rowloom.operators.quantiles import SMALL_ROWS, column_quantiles


def replace_columns(df: DataFrame, new: Mapping[str, Column | str]) -> DataFrame:
    """Swap columns for expressions (or SQL text) in one projection, order kept."""
    picked: list = []
    for name in df.columns:
        value = new.get(name)
        if value is None:
            picked.append(q(name))
        elif isinstance(value, str):
            picked.append(F.expr(f"{value} as {q(name)}"))
        else:
            picked.append(value.alias(name))
    return df.select(*picked)


# ---------------------------------------------------------------- standardise


@dataclass
class Standardizer:
    """(x - mean) / population deviation; a constant column becomes 0."""

    moments: dict[str, tuple[float, float]]

    @classmethod
    def fit(
        cls, df: DataFrame, cols: Sequence[str], scope: str = "all", layout: Layout = DEFAULT
    ) -> Standardizer:
        if not cols:
            return cls({})
        row = fit_rows(df, scope, layout).selectExpr(
            *[f"avg(cast({q(c)} as double)) as m{i}" for i, c in enumerate(cols)],
            *[f"stddev_pop(cast({q(c)} as double)) as s{i}" for i, c in enumerate(cols)],
        ).first()
        return cls({c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)})

    def expressions(self) -> dict[str, str]:
        out = {}
        for name, (mean, deviation) in self.moments.items():
            out[name] = f"cast({q(name)} as double)"
            if mean is not None:
                # a rounding residue in the deviation of a constant column counts as zero
                flat = deviation <= 1e-14 * max(abs(mean), 1e-300)
                scale = sql_number(1.0 if flat else deviation)
                out[name] = f"({out[name]} - {sql_number(mean)}) / {scale}"
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return replace_columns(df, self.expressions())


# ----------------------------------------------------------------- winsorise


@dataclass
class Winsorizer:
    """Limits columns to their lower and upper quantile."""

    bounds: dict[str, tuple[float, float]]

    @classmethod
    def fit(
        cls, df: DataFrame, cols: Sequence[str], tail: float = 0.01, scope: str = "all",
        layout: Layout = DEFAULT, small_rows: int = SMALL_ROWS,
    ) -> Winsorizer:
        found = column_quantiles(
            fit_rows(df, scope, layout), {c: [tail, 1 - tail] for c in cols}, small_rows=small_rows
        )
        return cls({c: (q[0], q[1]) for c, q in found.items() if q is not None})

    def transform(self, df: DataFrame) -> DataFrame:
        new = {c: clip(col(c).cast("double"), lo, hi) for c, (lo, hi) in self.bounds.items()}
        return replace_columns(df, new)


# --------------------------------------------------------------- Yeo-Johnson

GRID = 33
FIRST_CENTRE, FIRST_STEP = 1.0, 0.25
PASSES = 3


def _profile(
    df: DataFrame, grids: Mapping[str, Sequence[float]], pivots: Sequence[float]
) -> dict[str, list[float]]:
    """Mean log-likelihood of each exponent on each column's grid, in one scan.

    Tasks reduce their rows to three sums per exponent, Spark adds these up, and
    only columns x exponents numbers reach the driver. ``pivots`` are typical values,
    around which the sums are taken.
    """
    names = list(grids)
    tables = [list(grids[n]) for n in names]

    def partial(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        def powers(logs, lam):
            return logs if abs(lam) < 1e-12 else np.expm1(lam * logs) / lam

        def transform(x, lam):
            """Transformed values from the logs of both signs' parts."""
            up, down = x
            return np.concatenate([powers(up, lam), -powers(down, 2 - lam)])

        def logs(x):
            return np.log1p(x[x >= 0]), np.log1p(-x[x < 0])

        size = max(len(t) for t in tables)
        sums = np.zeros((len(tables), size, 4))
        for batch in batches:
            for i, lams in enumerate(tables):
                x = batch[f"x{i}"].to_numpy(dtype="float64", na_value=np.nan)
                x = x[~np.isnan(x)]
                if not len(x):
                    continue
                parts, pivot = logs(x), logs(np.array([pivots[i]]))
                signed = float(parts[0].sum() - parts[1].sum())
                for j, lam in enumerate(lams):
                    # sums around a fixed point keep their digits when merged
                    t = transform(parts, lam) - transform(pivot, lam)[0]
                    sums[i, j] += (len(x), t.sum(), (t * t).sum(), signed)
        rows = [
            (i, j, *sums[i, j]) for i, lams in enumerate(tables) for j in range(len(lams))
        ]
        yield pd.DataFrame(rows, columns=["i", "j", "n", "s1", "s2", "sl"])

    slim = df.select(*[col(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)])
    merged = (
        slim.mapInPandas(partial, "i int, j int, n double, s1 double, s2 double, sl double")
        .groupBy("i", "j")
        .agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2", "sl")])
        .collect()
    )
    out = {n: [-math.inf] * len(grids[n]) for n in names}
    for r in merged:
        if not r["n"]:
            continue
        mean = r["s1"] / r["n"]
        var = r["s2"] / r["n"] - mean * mean
        lam = tables[r["i"]][r["j"]]
        # a spread below the float resolution says nothing about the exponent
        if var > 1e-24:
            out[names[r["i"]]][r["j"]] = -0.5 * math.log(var) + (lam - 1) * r["sl"] / r["n"]
    return out


def _vertex(x: Sequence[float], y: Sequence[float], i: int) -> float:
    """Top of the parabola through the best grid point and its neighbours."""
    if i == 0 or i == len(x) - 1:
        return x[i]
    left, mid, right = y[i - 1], y[i], y[i + 1]
    curve = left - 2 * mid + right
    if not curve < 0:
        return x[i]
    return x[i] + (x[i + 1] - x[i]) * 0.5 * (left - right) / curve


@dataclass
class YeoJohnson:
    """Yeo-Johnson with the most likely exponent, then population standardising.

    The exponent is found on a grid that is narrowed around its best point; all
    columns share each scan. It is rounded to six digits, so that the order in
    which partial sums arrive cannot change the result.
    """

    exponents: dict[str, float]
    scaler: Standardizer

    @classmethod
    def fit(
        cls, df: DataFrame, cols: Sequence[str], scope: str = "all", layout: Layout = DEFAULT,
        digits: int = 6,
    ) -> YeoJohnson:
        rows = fit_rows(df, scope, layout).select(*[q(c) for c in cols])
        # several passes read just these columns; lost blocks are recomputed
        rows = rows.persist()
        try:
            exponents = cls.search(rows, cols, digits)
            powered = {c: yeo_johnson(col(c), v) for c, v in exponents.items()}
            return cls(exponents, Standardizer.fit(replace_columns(rows, powered), cols))
        finally:
            rows.unpersist()

    @staticmethod
    def search(rows: DataFrame, cols: Sequence[str], digits: int = 6) -> dict[str, float]:
        half = GRID // 2
        centre = dict.fromkeys(cols, FIRST_CENTRE)
        step, best, passes = FIRST_STEP, {}, 0
        means = rows.agg(
            *[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]
        ).first()
        pivots = [float(means[f"m{i}"] or 0.0) for i in range(len(cols))]
        while passes < PASSES:
            grids = {c: [centre[c] + (j - half) * step for j in range(GRID)] for c in cols}
            profile = _profile(rows, grids, pivots)
            moved = False
            for c in cols:
                top = max(range(GRID), key=lambda j: profile[c][j])
                if profile[c][top] == float("-inf"):
                    # constant or empty column: leave its values as they are
                    best[c], centre[c] = 1.0, 1.0
                    continue
                edge = top in (0, GRID - 1) and passes == 0 and abs(centre[c]) < 64
                moved = moved or edge
                centre[c], best[c] = grids[c][top], _vertex(grids[c], profile[c], top)
            if not moved:
                step /= half
                passes += 1
        return {c: round(best[c], digits) for c in cols}

    def transform(self, df: DataFrame) -> DataFrame:
        powered = replace_columns(
            df, {c: yeo_johnson(col(c), v) for c, v in self.exponents.items()}
        )
        return self.scaler.transform(powered)


# ------------------------------------------------------------- quantile bins


@dataclass
class QuantileBins:
    """Right-closed bins between distinct quantiles; a sentinel value becomes -1."""

    edges: dict[str, list[float]]
    sentinels: dict[str, float]

    @classmethod
    def fit(
        cls, df: DataFrame, cols: Sequence[str], bins: int = 100,
        sentinels: Mapping[str, float] | None = None, scope: str = "all",
        layout: Layout = DEFAULT, small_rows: int = SMALL_ROWS,
    ) -> QuantileBins:
        sentinels = {c: v for c, v in (sentinels or {}).items() if c in cols}
        shares = [i / bins for i in range(bins + 1)]
        found = column_quantiles(
            fit_rows(df, scope, layout),
            {c: shares for c in cols},
            {c: col(c) != F.lit(v) for c, v in sentinels.items()},
            small_rows=small_rows,
        )
        return cls({c: sorted(set(q or [])) for c, q in found.items()}, sentinels)

    def transform(self, df: DataFrame, as_text: bool = True) -> DataFrame:
        # Bins are closed on the right and the bucket search on the left, so the
        # search runs on negated values: position from the top instead of the bottom.
        flipped = {f"_neg_{c}": [-e for e in reversed(es[1:-1])] for c, es in self.edges.items()}
        out = df.withColumns({f"_neg_{c}": -col(c).cast("double") for c in self.edges})
        out = bucket_columns(out, flipped, "_at")
        new = {}
        for name, edges in self.edges.items():
            inner = max(len(edges) - 2, 0)
            code = F.lit(inner) - col(f"_at_neg_{name}")
            if name in self.sentinels:
                code = F.when(col(name) == F.lit(self.sentinels[name]), F.lit(-1)).otherwise(code)
            code = F.when(col(name).isNotNull(), code).cast("int")
            new[name] = code.cast("string") if as_text else code
        return replace_columns(out, new).select(*[q(c) for c in df.columns])


# --------------------------------------------------------------- interactions


def product_columns(cols: Sequence[str]) -> list[tuple[str, str, str]]:
    return [(a, b, f"{a}_{b}") for a, b in combinations(cols, 2)]


def add_products(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add the product of every pair of columns, all in one projection."""
    products = [f"{q(a)} * {q(b)} as {q(name)}" for a, b, name in product_columns(cols)]
    return df.selectExpr(*[q(c) for c in df.columns], *products)
