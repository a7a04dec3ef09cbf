"""Encodings of string columns whose levels are learnt from the table itself."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.layout import DEFAULT, TRAIN, Layout
from rowloom.operators.columns import col, q, sql_number, sql_text
from rowloom.operators.joins import BROADCAST_ROWS, lookup, small_copy, small_or_settled
from rowloom.session import settle


def as_long(df: DataFrame, keep: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per (row, column): the kept columns, ``col`` and the text ``level``."""
    cells = ", ".join(
        f"struct({sql_text(c)} as col, cast({q(c)} as string) as level)" for c in cols
    )
    exploded = df.selectExpr(*[q(k) for k in keep], f"explode(array({cells})) as _cell")
    return exploded.select(*[q(k) for k in keep], "_cell.col", "_cell.level")


def fit_rows(df: DataFrame, scope: str, layout: Layout) -> DataFrame:
    """Rows an encoder learns from: all of them, or the train part only."""
    if scope == "all" or layout.split not in df.columns:
        return df
    if scope == "train":
        return df.where(col(layout.split) == TRAIN)
    raise ValueError(f"unknown fit scope {scope!r}")


def level_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per (column, level), NULL being a level; partial counts shrink the shuffle."""
    return as_long(df, [], cols).groupBy("col", "level").agg(F.count(F.lit(1)).alias("rows"))


def distinct_counts(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """Number of different non-null values per column: ``(col, n_distinct)``."""
    if approximate:
        row = df.agg(*[F.approx_count_distinct(col(c)).alias(f"c{i}") for i, c in enumerate(cols)])
        pairs = [F.struct(F.lit(c).alias("col"), F.col(f"c{i}").alias("n")) for i, c in enumerate(cols)]
        return row.select(F.explode(F.array(*pairs)).alias("p")).select(
            "p.col", F.col("p.n").alias("n_distinct")
        )
    return (
        level_counts(df, cols)
        .groupBy("col")
        .agg(F.count("level").alias("n_distinct"))
    )


def route_by_cardinality(
    df: DataFrame, cols: Sequence[str], threshold: int = 3, exclude: Sequence[str] = ()
) -> tuple[list[str], list[str]]:
    """Columns with at least ``threshold`` levels, and the others, both sorted."""
    picked = sorted(set(cols) - set(exclude))
    if not picked:
        return [], []
    counts = {r["col"]: r["n_distinct"] for r in distinct_counts(df, picked).collect()}
    high = [c for c in picked if counts.get(c, 0) >= threshold]
    return high, [c for c in picked if c not in high]


# ---------------------------------------------------------------- label codes


@dataclass
class LabelCodes:
    """Sorted levels numbered from 0, NULL last, given out as text."""

    cols: list[str]
    table: DataFrame  # col, level, rows, code
    null_code: dict[str, int]
    small: bool

    @classmethod
    def fit(
        cls, df: DataFrame, cols: Sequence[str], scope: str = "all", layout: Layout = DEFAULT,
        max_rows: int = BROADCAST_ROWS,
    ) -> LabelCodes:
        levels = level_counts(fit_rows(df, scope, layout), cols)
        levels, small = small_or_settled(levels, "levels", max_rows)
        known = levels.where("level is not null")
        if small:
            by_level = Window.partitionBy("col").orderBy("level")
            known = small_copy(known.withColumn("code", F.row_number().over(by_level) - 1), max_rows)
        else:
            known = _ordinals(known)
        sizes = {r["col"]: r["count"] for r in known.groupBy("col").count().collect()}
        return cls(list(cols), known, {c: sizes.get(c, 0) for c in cols}, small)

    def transform(
        self, df: DataFrame, as_text: bool = True, layout: Layout = DEFAULT
    ) -> DataFrame:
        out, codes = df, {}
        for i, name in enumerate(self.cols):
            table = self.table.where(F.col("col") == name)
            table = table.selectExpr(f"level as _level{i}", f"code as _code{i}", "rows")
            if self.small:
                match = F.expr(f"cast({q(name)} as string) = _level{i}")
                out = out.join(F.broadcast(table.drop("rows")), match, "left")
            else:
                out = out.withColumn(f"_level{i}", col(name).cast("string"))
                out = lookup(out, table, [f"_level{i}"], [f"_code{i}"], "rows", col(layout.id))
            code = f"case when {q(name)} is null then {self.null_code[name]} else _code{i} end"
            codes[name] = f"cast({code} as {'string' if as_text else 'double'}) as {q(name)}"
        return out.selectExpr(*[codes.get(c, q(c)) for c in df.columns])


def _ordinals(levels: DataFrame) -> DataFrame:
    """Number many levels per column in sorted order without one global sort task.

    The sorted table is written once; each of its partitions then knows its first
    row number from the partition sizes.
    """
    ordered = settle(
        levels.orderBy("col", "level").withColumn("_id", F.monotonically_increasing_id()), "ordered"
    ).withColumn("_part", F.shiftright("_id", 33))
    cells = ordered.groupBy("col", "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")
    )
    before = Window.partitionBy("col").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        "col", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    code = (F.col("_off") + F.col("_id") - F.col("_first")).cast("int")
    numbered = ordered.join(cells, ["col", "_part"]).select(
        "col", "level", "rows", code.alias("code")
    )
    return settle(numbered, "codes")


# -------------------------------------------------------------------- one-hot


@dataclass
class OneHot:
    """One 0/1 column per level, named ``{column}_{level}``, levels sorted, NULL last.

    The output is as wide as there are levels, so the number of levels is checked;
    ``one_hot_vector`` is the way for more of them.
    """

    levels: dict[str, list[str | None]]
    kind: str = "double"
    null_name: str = "nan"

    @classmethod
    def fit(
        cls, df: DataFrame, cols: Sequence[str], drop_first: bool = False, kind: str = "double",
        null_name: str = "nan", scope: str = "all", layout: Layout = DEFAULT,
        max_columns: int = 5_000,
    ) -> OneHot:
        if not cols:
            return cls({}, kind, null_name)
        found = level_counts(fit_rows(df, scope, layout), cols).select("col", "level")
        found = found.limit(max_columns + 1).collect()
        if len(found) > max_columns:
            raise ValueError(f"over {max_columns} levels: use one_hot_vector for these columns")
        levels: dict[str, list[str | None]] = {}
        for name in cols:
            mine = [r["level"] for r in found if r["col"] == name]
            known = sorted(v for v in mine if v is not None)
            levels[name] = (known + [None] * (None in mine))[1 if drop_first else 0:]
        return cls(levels, kind, null_name)

    def names(self) -> list[str]:
        return [self._name(c, v) for c, vs in self.levels.items() for v in vs]

    def _name(self, name, level) -> str:
        return f"{name}_{self.null_name if level is None else level}"

    def expressions(self):
        for name, levels in self.levels.items():
            for level in levels:
                x = f"cast({q(name)} as string)"
                # <=> is never NULL, so an absent value is 0 in all other columns
                hit = f"{x} is null" if level is None else f"{x} <=> {sql_text(level)}"
                yield f"cast({hit} as {self.kind}) as {q(self._name(name, level))}"

    def transform(self, df: DataFrame) -> DataFrame:
        kept = [q(c) for c in df.columns if c not in self.levels]
        return df.selectExpr(*kept, *self.expressions())


def one_hot_vector(
    df: DataFrame, cols: Sequence[str], out: str = "one_hot", layout: Layout = DEFAULT
) -> DataFrame:
    """All levels of each column as one sparse vector column per input column."""
    codes = LabelCodes.fit(df, cols, layout=layout)
    indexed = codes.transform(df, as_text=False, layout=layout)
    names = [f"{out}_{c}" for c in cols]
    encoder = OneHotEncoder(inputCols=list(cols), outputCols=names, dropLast=False)
    return encoder.fit(indexed).transform(indexed).drop(*cols)


# ------------------------------------------------------------ target encoding


@dataclass
class TargetEncoder:
    """Out-of-fold target means.

    A train row gets the mean label of its level over the rows of the other folds
    (NULL if there are none). A test row gets the average over folds of that mean,
    where a level missing from a fold counts with the plain average of the fold's
    level means. Everything follows from label sum and row count per level and
    fold, gathered for all columns in one aggregation.
    """

    cols: list[str]
    k: int
    table: DataFrame  # col, level, rows, te[k]
    fill: dict[str, list[float | None]]
    sizes: dict[str, int]
    small: bool

    @classmethod
    def fit(
        cls, df: DataFrame, cols: Sequence[str], k: int = 5, layout: Layout = DEFAULT,
        max_rows: int = BROADCAST_ROWS,
    ) -> TargetEncoder:
        cols = list(cols)
        train = fit_rows(df, "train", layout).where(col(layout.label).isNotNull())
        y, fold = col(layout.label).cast("double"), col(layout.fold)
        long = as_long(train.withColumn(layout.label, y), [layout.label, layout.fold], cols)
        long = long.where("level is not null")
        sums = [F.coalesce(F.sum(F.when(fold == f, col(layout.label))), F.lit(0.0)).alias(f"s{f}") for f in range(k)]
        rows = [F.count(F.when(fold == f, 1)).alias(f"n{f}") for f in range(k)]
        stats = long.groupBy("col", "level").agg(
            F.count(F.lit(1)).alias("rows"), F.sum(layout.label).alias("s"), *sums, *rows
        )
        rest = [F.nullif(F.col("rows") - F.col(f"n{f}"), F.lit(0)) for f in range(k)]
        te = F.array(*[(F.col("s") - F.col(f"s{f}")) / rest[f] for f in range(k)])
        table = stats.select("col", "level", "rows", te.alias("te"))
        table, small = small_or_settled(table, "levels", max_rows)
        fill = table.groupBy("col").agg(
            F.count(F.lit(1)).alias("n"), *[F.avg(F.get("te", F.lit(f))).alias(f"f{f}") for f in range(k)]
        )
        fill = {r["col"]: r for r in fill.collect()}
        return cls(
            cols, k, table,
            {c: [fill[c][f"f{f}"] if c in fill else None for f in range(k)] for c in cols},
            {c: fill[c]["n"] if c in fill else 0 for c in cols},
            small,
        )

    def _value(self, te: str, fill: Sequence[str], layout: Layout) -> str:
        """Encoding of one row, as SQL, from its level's array of fold means."""
        parts = " + ".join(f"coalesce(get({te}, {f}), {fill[f]})" for f in range(self.k))
        train = f"{q(layout.split)} = {sql_text(TRAIN)}"
        return f"case when {train} then get({te}, {q(layout.fold)}) else ({parts}) / {self.k}D end"

    def transform(
        self, df: DataFrame, layout: Layout = DEFAULT, max_rows: int = BROADCAST_ROWS
    ) -> DataFrame:
        """Add ``{column}_te`` for every fitted column."""
        narrow, budget = [], max_rows * 5
        for name in sorted(self.cols, key=lambda c: self.sizes[c]):
            if self.small or (self.sizes[name] <= max_rows and self.sizes[name] <= budget):
                budget -= self.sizes[name]
                narrow.append(name)
        wide = [c for c in self.cols if c not in narrow]
        out, values = df, []
        for i, name in enumerate(narrow):
            means = self.table.where(F.col("col") == name).selectExpr(
                f"level as _level{i}", f"te as _te{i}"
            )
            match = F.expr(f"cast({q(name)} as string) = _level{i}")
            out = out.join(F.broadcast(means), match, "left")
            fill = [sql_number(v) for v in self.fill[name]]
            values.append(f"{self._value(f'_te{i}', fill, layout)} as {q(name + '_te')}")
        out = out.selectExpr(*[q(c) for c in df.columns], *values)
        if wide:
            out = out.join(self._wide(df, wide, layout), layout.id)
        return out.select(*[q(c) for c in df.columns], *[q(f"{c}_te") for c in self.cols])

    def _wide(self, df: DataFrame, names: list[str], layout: Layout) -> DataFrame:
        """Encodings of columns with many levels: one shuffled join for all of them."""
        long = as_long(df, [layout.id, layout.split, layout.fold], names)
        fills = {
            n: f"array({', '.join(sql_number(v) for v in self.fill[n])})" for n in names
        }
        fill = "case " + " ".join(f"when col = {sql_text(n)} then {v}" for n, v in fills.items()) + " end"
        means = self.table.where(F.col("col").isin(names)).selectExpr("*", f"{fill} as _fill")
        test = " + ".join(f"coalesce(get(te, {f}), get(_fill, {f}))" for f in range(self.k))
        means = means.selectExpr("col", "level", "rows", "te", f"({test}) / {self.k}D as _test")
        found = lookup(
            long, means, ["col", "level"], ["te", "_test"], "rows",
            F.struct(col(layout.id), F.col("col")), small=False,
        )
        # a level without train rows gets the average of the fills
        missed = {
            n: "(" + " + ".join(sql_number(v) for v in self.fill[n]) + f") / {self.k}D" for n in names
        }
        miss = "case " + " ".join(f"when col = {sql_text(n)} then {v}" for n, v in missed.items()) + " end"
        value = (
            f"case when {q(layout.split)} = {sql_text(TRAIN)} then get(te, {q(layout.fold)})"
            f" else coalesce(_test, {miss}) end"
        )
        found = found.selectExpr(q(layout.id), "col", f"{value} as _v")
        picks = [
            F.expr(f"max(case when col = {sql_text(n)} then _v end) as {q(n + '_te')}") for n in names
        ]
        return found.groupBy(layout.id).agg(*picks)


# -------------------------------------------------------------------- crosses


def cross_columns(cols: Sequence[str]) -> list[tuple[str, str, str]]:
    """All unordered pairs in table order with the name of their cross."""
    return [(a, b, f"{a}_x_{b}") for a, b in combinations(cols, 2)]


def cross_categories(df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The kept columns and the joined texts of every pair; NULL if either side is NULL."""
    crosses = [
        f"concat(cast({q(a)} as string), '_', cast({q(b)} as string)) as {q(name)}"
        for a, b, name in cross_columns(cols)
    ]
    return df.selectExpr(*[q(k) for k in keep], *crosses)
