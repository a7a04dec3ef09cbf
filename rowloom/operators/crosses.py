"""Out-of-fold label means of all pairs of columns, on packed codes instead of joined texts.

A cell becomes a 64-bit code: text levels are numbered, numbers take the hash of their 64 bits, which is
one-to-one. A cross is (pair, code, code). Pairs with few levels are fitted together by one aggregation of
longs; their keys are packed into one sorted array each and found by binary search inside tasks.

A pair with many levels would take a row for each row of the table, so nothing is exploded for it. Whole rows
are dealt by the code of one of its columns, an anchor: all crosses with that column are then complete inside
a task, where they are counted and looked up at once, and what is found is a further column of the row. A row
moves once for each anchor, however many pairs that has, and is never joined back by its id. Codes of an
anchor with too many rows for a task are spread; their crosses are dealt by the other column, and crosses of
two such codes, which are few, are fitted and searched like pairs with few levels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.layout import DEFAULT, TRAIN, Layout
from rowloom.operators.categories import LabelCodes, cross_columns
from rowloom.operators.columns import col
from rowloom.session import passing_shuffles, settle

#: bytes of fitted pairs that tasks hold, and those of them for the frequent codes of a larger pair
HELD_BYTES, HOT_BYTES = 64 << 20, 1 << 20
#: a code is frequent with more rows than this and than a thousandth of all; rows looked at to tell
HOT_ROWS, HOT_SHARE, HOT_SAMPLE = 100_000, 1000, 200_000
#: rows that a task counts at once for up to so many pairs (fewer rows for more pairs), numbers that rows with frequent codes are spread by
CHUNK_ROWS, BATCH_PAIRS, SPREAD = 1 << 16, 8, 1 << 16


@dataclass
class _Held:
    """Fitted pairs as arrays: sorted codes of each column, packed keys and means of each pair."""

    codes: dict[str, np.ndarray] = field(default_factory=dict)
    keys: list[np.ndarray] = field(default_factory=list)
    means: list[np.ndarray] = field(default_factory=list)


def _place(known: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Index of each code among the sorted known ones, -1 for others."""
    if not len(known):
        return np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return np.where(known[at] == codes, at, -1)


@dataclass
class _Anchor:
    """What is counted where rows are dealt by one column: pairs, their other column, and if its frequent codes only."""

    x: int
    jobs: list[tuple[int, int, bool]]
    k: int
    chunk: int = 0

    def others(self) -> list[int]:
        return sorted({other for _, other, _ in self.jobs})

    def pieces(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
        """Tables of sorted rows that no code of the anchor spans, which rows have a code to count, numbers of the codes."""
        kept: list[pa.RecordBatch] = []
        rows, need = 0, self.chunk
        for batch in batches:
            kept.append(batch)
            rows += batch.num_rows
            if rows >= need:
                table = pa.Table.from_batches(kept).combine_chunks()
                codes, plain = self._codes(table)
                # rows without a code to count may be cut anywhere
                ends = np.flatnonzero((codes != codes[-1]) | ~plain)
                end = rows if not plain[-1] else ends[-1] + 1 if len(ends) else 0
                if end:
                    yield self._numbered(table.slice(0, end))
                kept = table.slice(end).to_batches()
                rows -= end
                need = max(self.chunk, 2 * rows)
        if rows:
            yield self._numbered(pa.Table.from_batches(kept).combine_chunks())

    def _codes(self, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        codes = table.column(f"_c{self.x}")
        return codes.fill_null(0).to_numpy(), ~codes.is_null().to_numpy() & ~_flags(table, self.x)

    def _numbered(self, table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        codes, plain = self._codes(table)
        return table, plain, np.cumsum(np.concatenate([[0], codes[1:] != codes[:-1]]))

    def crosses(self, table: pa.Table, plain: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each pair: its rows, their crosses by number, and means and rows of each cross outside each fold."""
        slots, labels = table.column("_slot").to_numpy(), table.column("_y")
        learnt, y = ~labels.is_null().to_numpy(), labels.fill_null(0).to_numpy()
        for pair, other, frequent in self.jobs:
            codes = table.column(f"_c{other}")
            mine = plain & ~codes.is_null().to_numpy()
            mine = np.flatnonzero(mine & _flags(table, other) if frequent else mine)
            if len(mine):
                _, place = np.unique(codes.fill_null(0).to_numpy()[mine], return_inverse=True)
                _, cross = np.unique(numbers[mine] * (int(place.max()) + 1) + place, return_inverse=True)
                known = learnt[mine]
                yield pair, mine, cross, *_fold_means(cross[known], int(cross.max()) + 1, slots[mine][known], y[mine][known], self.k)


def _flags(table: pa.Table, x: int) -> np.ndarray:
    """Rows whose code is frequent."""
    name = f"_hot{x}"
    return table.column(name).to_numpy() if name in table.column_names else np.zeros(table.num_rows, bool)


def _fold_means(cross: np.ndarray, n: int, slots: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Label mean (NaN without rows) and number of the rows outside each fold, for each of ``n`` crosses."""
    cell = cross * (k + 1) + np.where((slots >= 0) & (slots < k), slots, k)
    counts = np.bincount(cell, minlength=n * (k + 1)).reshape(n, k + 1)
    sums = np.bincount(cell, weights=y, minlength=n * (k + 1)).reshape(n, k + 1)
    rest = counts.sum(1)[:, None] - counts[:, :k]
    return (sums.sum(1)[:, None] - sums[:, :k]) / np.where(rest > 0, rest, np.nan), rest


@dataclass
class CrossMeans:
    """Label means of crosses: for train rows of the other folds, for test rows averaged over the folds.

    As in ``TargetEncoder``: a fold without a level counts, in that average, with the plain mean of its level
    means, and so do levels without train rows; a cross with a NULL side is missing in train rows.
    """

    cols: list[str]
    k: int
    coded: DataFrame  # id, kept columns, slot, label, and columns that have no kept one to take their codes from
    kept: list[str]
    text: list[str]
    whole: list[int]  # pairs that the table holds whole; of others it has crosses of frequent codes
    hot: list[list[int]]  # frequent codes of each column
    levels: list[int]  # of each column, roughly
    table: DataFrame | None  # pair, a, b, te[k]
    fill: list[list[float | None]] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], k: int = 5, layout: Layout = DEFAULT, keep: Sequence[str] = ()) -> CrossMeans:
        """Learn from the train rows of ``df``; columns named by ``keep`` stay beside the means of their row."""
        cols, kept = list(cols), [c for c in keep if c != layout.id]
        kinds = dict(df.dtypes)
        text = [c for c in cols if kinds[c] in ("string", "boolean", "date", "timestamp")]
        train = col(layout.split) == TRAIN
        own = {
            "_slot": F.when(train, F.coalesce(col(layout.fold), F.lit(-1))).otherwise(k).cast("int"),
            "_y": F.when(train, col(layout.label).cast("double")),
        }
        raw = [f"_v{i}" for i, c in enumerate(cols) if c in text or c not in kept]
        numbered = df.select(col(layout.id), *[col(c) for c in kept], *[x.alias(n) for n, x in own.items()], *[
            (col(c).cast("string") if c in text else col(c)).alias(f"_v{i}") for i, c in enumerate(cols) if f"_v{i}" in raw
        ])
        levelled = [f"_v{i}" for i, c in enumerate(cols) if c in text]
        if text:
            # levels of text that are NULL are no level of a cross
            numbered = numbered.withColumns({f"_null{v}": col(v).isNull() for v in levelled})
            numbered = LabelCodes.fit(numbered, levelled, layout=layout).transform(numbered, as_text=False, layout=layout)
            numbered = numbered.withColumns({v: F.when(~F.col(f"_null{v}"), col(v).cast("int")) for v in levelled})
        # read by every pass, so written once
        coded = settle(numbered.select(col(layout.id), *[col(c) for c in kept], *own, *raw), "codes", passing=True)
        self = cls(cols, k, coded, kept, text, [], [[] for _ in cols], [], None)
        self._measure()
        self._learn()
        return self

    def _sides(self) -> list[tuple[int, int]]:
        return [(i, j) for i in range(len(self.cols)) for j in range(i + 1, len(self.cols))]

    def _raw(self, i: int) -> str:
        """Name of the coded table's column that gives the code."""
        name = self.cols[i]
        return name if name in self.kept and name not in self.text else f"_v{i}"

    def _code(self, i: int) -> Column:
        raw = col(self._raw(i))
        return raw.cast("long") if self.cols[i] in self.text else F.when(raw.isNotNull(), F.xxhash64(raw))

    def _flagged(self, i: int) -> list[Column]:
        """Whether the code of a column is frequent, if it has any such."""
        return [F.coalesce(F.col(f"_c{i}").isin(self.hot[i]), F.lit(False)).alias(f"_hot{i}")] if self.hot[i] else []

    def _measure(self) -> None:
        """Levels of the columns and their frequent codes; they decide how a pair is worked on, not what it gives."""
        codes = [self._code(i).alias(f"_c{i}") for i in range(len(self.cols))]
        rows, *self.levels = self.coded.select(*codes).agg(F.count(F.lit(1)), *[F.approx_count_distinct(f"_c{i}") for i in range(len(codes))]).first()
        budget, sides = HELD_BYTES, self._sides()
        # the numbers of levels are not exact, so a little more is reckoned with
        most = [min(rows, int(1.3 * self.levels[i] * self.levels[j])) for i, j in sides]
        # crosses are counted where their number matters: there may be too many, but not for one of the columns alone
        open_ = [p for p, (i, j) in enumerate(sides) if self._bytes(most[p]) > HELD_BYTES // len(sides) and self._bytes(max(self.levels[i], self.levels[j])) <= HELD_BYTES]
        if open_:
            ends = [[f"_c{x}" for x in sides[p]] for p in open_]
            pairs = [F.approx_count_distinct(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.xxhash64(a, b))) for a, b in ends]
            for p, found in zip(open_, self.coded.select(*codes).agg(*pairs).first()):
                most[p] = min(most[p], int(1.2 * found))
        for p in sorted(range(len(sides)), key=most.__getitem__):
            if self._bytes(most[p]) <= budget:
                budget -= self._bytes(most[p])
                self.whole.append(p)
        if rows > HOT_ROWS and sides:
            seen = self.coded.select(*codes).sample(min(1.0, HOT_SAMPLE / rows), seed=1).toArrow()
            bar = max(HOT_ROWS, rows / HOT_SHARE) * seen.num_rows / rows
            for i in range(len(codes)):
                found, times = np.unique(seen.column(f"_c{i}").drop_null().to_numpy(), return_counts=True)
                self.hot[i] = found[times > bar].tolist()

    def _bytes(self, levels: int) -> int:
        # codes, packed key and means
        return levels * 8 * (self.k + 4)

    def _dealt_by(self, p: int) -> tuple[int, int, bool]:
        """Anchor and other column of a larger pair, and if all crosses of the anchor's frequent codes are held."""
        i, j = self._sides()[p]
        x, other = (i, j) if self.levels[i] >= self.levels[j] else (j, i)
        return x, other, self._bytes(int(1.3 * len(self.hot[x]) * self.levels[other])) <= HOT_BYTES

    def _anchors(self, pairs: Sequence[int]) -> list[_Anchor]:
        """Passes for the larger pairs, columns with most levels first: they leave most means missing."""
        found: dict[int, _Anchor] = {}
        for p in pairs:
            x, other, held = self._dealt_by(p)
            found.setdefault(x, _Anchor(x, [], self.k)).jobs.append((p, other, False))
            if self.hot[x] and not held:
                found.setdefault(other, _Anchor(other, [], self.k)).jobs.append((p, x, True))
        for anchor in found.values():
            anchor.chunk = -(-CHUNK_ROWS * min(BATCH_PAIRS, len(anchor.jobs)) // len(anchor.jobs))
        return sorted(found.values(), key=lambda a: (-self.levels[a.x], a.x))

    def _learn(self) -> None:
        """Table of the pairs with few levels, and for every pair the mean of its level means in each fold."""
        k, sides = self.k, self._sides()
        learnt = self.coded.where("_y is not null")
        wide = [p for p in range(len(sides)) if p not in self.whole]
        partial = [p for p in wide if self.hot[self._dealt_by(p)[0]]]
        parts = []
        if self.whole or partial:
            coded = learnt.select("_slot", "_y", *[self._code(i).alias(f"_c{i}") for i in range(len(self.cols))])
            coded = coded.select("*", *[x for i in range(len(self.cols)) for x in self._flagged(i)])
            cells = []
            for p in sorted([*self.whole, *partial]):
                i, j = sides[p]
                cell = F.struct(F.lit(p).alias("pair"), F.col(f"_c{i}").alias("a"), F.col(f"_c{j}").alias("b"))
                cells.append(F.when(self._frequent(p, lambda x: F.col(f"_hot{x}")), cell) if p in partial else cell)
            long = coded.select("_slot", "_y", F.explode(F.array(*cells)).alias("_x")).select("_slot", "_y", "_x.*").where("a is not null and b is not null")
            fold, y = F.col("_slot"), F.col("_y")
            stats = long.groupBy("pair", "a", "b").agg(
                F.count(F.lit(1)).alias("rows"), F.sum(y).alias("s"),
                *[F.coalesce(F.sum(F.when(fold == f, y)), F.lit(0.0)).alias(f"s{f}") for f in range(k)],
                *[F.count(F.when(fold == f, 1)).alias(f"n{f}") for f in range(k)],
            )
            te = [(F.col("s") - F.col(f"s{f}")) / F.nullif(F.col("rows") - F.col(f"n{f}"), F.lit(0)) for f in range(k)]
            self.table = settle(stats.select("pair", "a", "b", F.array(*te).alias("te")), "crosses", passing=True)
            mean = [F.get("te", F.lit(f)) for f in range(k)]
            parts += self.table.groupBy("pair").agg(F.count(F.lit(1)), *map(F.sum, mean), *map(F.count, mean)).collect()
        for anchor in self._anchors(wide):
            parts += self._totals(learnt, anchor)
        # a row a pair, from the table and from each anchor
        n, sums, counts = ({p: np.zeros(w) for p in range(len(sides))} for w in (1, k, k))
        for p, rows, *rest in parts:
            n[p] += rows
            sums[p] += [x or 0.0 for x in rest[:k]]
            counts[p] += rest[k:]
        self.sizes = [int(n[p][0]) for p in range(len(sides))]
        self.fill = [[float(s / c) if c else None for s, c in zip(sums[p], counts[p])] for p in range(len(sides))]

    def _frequent(self, p: int, flag) -> Column:
        """Crosses of a larger pair that are held: of frequent codes of the anchor with those, or all, of the other column."""
        x, other, held = self._dealt_by(p)
        return flag(x) if held else flag(x) & (flag(other) if self.hot[other] else F.lit(False))

    def _dealt(self, rows: DataFrame, anchor: _Anchor, spread: Sequence[Column] = ()) -> DataFrame:
        """Rows dealt and sorted by the anchor's code, with the codes that are counted beside them."""
        code = self._code(anchor.x)
        loose = code.isNull() | code.isin(self.hot[anchor.x]) if self.hot[anchor.x] else code.isNull()
        if spread:
            rows = rows.repartition(code, F.when(loose, F.pmod(F.xxhash64(*spread), F.lit(SPREAD)) + 1).otherwise(0))
        else:
            rows = rows.where(~loose).repartition(code)
        rows = rows.select("*", *[self._code(i).alias(f"_c{i}") for i in sorted({anchor.x, *anchor.others()})])
        return rows.select("*", *[x for i in sorted({anchor.x, *anchor.others()}) for x in self._flagged(i)]).sortWithinPartitions(f"_c{anchor.x}")

    def _totals(self, learnt: DataFrame, anchor: _Anchor) -> list:
        """(pair, levels, sum and number of the level means of each fold) of an anchor's pairs."""
        k, spark = self.k, learnt.sparkSession
        slim = learnt.select("_slot", "_y", *[col(self._raw(i)) for i in [anchor.x, *anchor.others()]])

        def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = {pair: np.zeros(1 + 2 * k) for pair, *_ in anchor.jobs}
            for piece in anchor.pieces(batches):
                for pair, _, _, te, rest in anchor.crosses(*piece):
                    known = rest > 0
                    found[pair] += np.concatenate([[len(te)], np.where(known, te, 0.0).sum(0), known.sum(0)])
            columns = np.array(list(found.values())).T
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), *map(pa.array, columns)], ["pair", *names])

        names = [f"n{i}" for i in range(1 + 2 * k)]
        with passing_shuffles(spark):
            parts = self._dealt(slim, anchor).mapInArrow(totals, ", ".join(["pair int", *[f"{x} double" for x in names]]))
            return parts.groupBy("pair").agg(*[F.sum(x) for x in names]).collect()

    def _tested(self, p: int) -> float | None:
        """What a test row gets whose cross has no train rows."""
        return None if None in self.fill[p] else sum(self.fill[p]) / self.k

    def _fills(self, p: int) -> np.ndarray:
        return np.array([np.nan if f is None else f for f in self.fill[p]])

    def _held(self, pairs: Sequence[int], partial: Sequence[int]) -> _Held:
        """Driver-side copy of the pairs within the byte bound, and of the frequent crosses of others."""
        held, sides, k = _Held(), self._sides(), self.k
        mine = F.col("pair").isin(list(pairs)) if pairs else F.lit(False)
        for p in partial:
            mine = mine | (F.col("pair") == p) & self._frequent(p, lambda x, p=p: F.col("a" if x == sides[p][0] else "b").isin(self.hot[x]))
        rows = self.table.where(mine).select("pair", "a", "b", *[F.get("te", F.lit(f)).alias(f"t{f}") for f in range(k)]).toArrow()
        every, a, b = (rows.column(x).to_numpy() for x in ("pair", "a", "b"))
        te = np.stack([rows.column(f"t{f}").to_numpy() for f in range(k)], 1)
        for p in [*pairs, *partial]:
            for side, c in zip(sides[p], (a, b)):
                name = f"_c{side}"
                held.codes[name] = np.unique(np.concatenate([held.codes.get(name, np.zeros(0, np.int64)), c[every == p]]))
        for p in [*pairs, *partial]:
            mine, (i, j) = every == p, sides[p]
            left, right = held.codes[f"_c{i}"], held.codes[f"_c{j}"]
            packed = np.searchsorted(left, a[mine]) * len(right) + np.searchsorted(right, b[mine])
            order = np.argsort(packed)
            means = te[mine][order]
            tested = np.where(np.isnan(means), self._fills(p), means).mean(1)
            held.keys.append(packed[order])
            held.means.append(np.column_stack([means, tested]))
        return held

    def transform(self, layout: Layout = DEFAULT, bytes_: int | None = None) -> DataFrame:
        """(id, kept columns, one ``{cross}_te`` per pair) of the rows that were given to ``fit``."""
        names = [f"{n}_te" for *_, n in cross_columns(self.cols)]
        budget, narrow = HELD_BYTES if bytes_ is None else bytes_, []
        for p in sorted(self.whole, key=self.sizes.__getitem__):
            if self._bytes(self.sizes[p]) <= budget:
                budget -= self._bytes(self.sizes[p])
                narrow.append(p)
        wide = [p for p in range(len(names)) if p not in narrow]
        rows, done = self.coded, []
        for anchor in self._anchors(wide):
            rows, done = self._counted(rows, anchor, done, layout)
        partial = [p for p in wide if self.hot[self._dealt_by(p)[0]]]
        if narrow or partial:
            rows = self._searched(rows, narrow, partial, wide, layout)
        return rows.select(col(layout.id), *[col(c) for c in self.kept], *[F.col(f"_p{p}").alias(n) for p, n in enumerate(names)])

    def _counted(self, rows: DataFrame, anchor: _Anchor, done: list[int], layout: Layout) -> tuple[DataFrame, list[int]]:
        """Rows with the means of an anchor's pairs beside them."""
        k, pairs = self.k, [p for p, *_ in anchor.jobs]
        fills = {p: self._fills(p) for p in pairs}
        missing = {p: np.nan if self._tested(p) is None else self._tested(p) for p in pairs}
        old = [c for c in rows.columns if c not in {f"_p{p}" for p in pairs}]
        schema = T.StructType([*[rows.schema[c] for c in old], *[T.StructField(f"_p{p}", T.DoubleType()) for p in pairs]])

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, plain, numbers in anchor.pieces(batches):
                slots = table.column("_slot").to_numpy()
                # crosses that were counted elsewhere stay; a cross that is nowhere is one without train rows
                values = {p: np.array(table.column(f"_p{p}").to_numpy()) if p in done else np.where(slots == k, missing[p], np.nan) for p in pairs}
                for p, mine, cross, te, _ in anchor.crosses(table, plain, numbers):
                    means = np.column_stack([te, np.where(np.isnan(te), fills[p], te).mean(1)])
                    slot = slots[mine]
                    values[p][mine] = np.where((slot >= 0) & (slot <= k), means[cross, np.clip(slot, 0, k)], np.nan)
                columns = [*[table.column(c) for c in old], *[pa.array(values[p], mask=np.isnan(values[p])) for p in pairs]]
                yield from pa.Table.from_arrays(columns, schema.names).to_batches()

        spread = [col(layout.id), *[self._code(i) for i in range(len(self.cols))]]
        out = self._dealt(rows, anchor, spread).mapInArrow(counted, schema)
        return out, [*done, *[p for p in pairs if p not in done]]

    def _searched(self, rows: DataFrame, pairs: Sequence[int], partial: Sequence[int], wide: Sequence[int], layout: Layout) -> DataFrame:
        """Rows with the means of the held pairs beside them; of partial pairs only held crosses are set."""
        spark, k = rows.sparkSession, self.k
        held, sides = spark.sparkContext.broadcast(self._held(pairs, partial)), self._sides()
        missing = [np.nan if self._tested(p) is None else self._tested(p) for p in pairs]
        plain = [layout.id, *self.kept, *[f"_p{p}" for p in wide if p not in partial]]
        found = [*pairs, *partial]
        schema = T.StructType([*[rows.schema[c] for c in plain], *[T.StructField(f"_p{p}", T.DoubleType()) for p in found]])
        rows = rows.select(*[col(c) for c in plain], "_slot", *[f"_p{p}" for p in partial], *[self._code(i).alias(f"_c{i}") for i in range(len(self.cols))])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = held.value
            for batch in batches:
                slots = batch.column("_slot").to_numpy()
                at, null = {}, {}
                for name, known in model.codes.items():
                    column = batch.column(name)
                    null[name] = column.is_null().to_numpy(zero_copy_only=False)
                    at[name] = _place(known, column.fill_null(0).to_numpy())
                columns = []
                for x, p in enumerate(found):
                    a, b = (f"_c{i}" for i in sides[p])
                    ok = (at[a] >= 0) & (at[b] >= 0) & ~null[a] & ~null[b]
                    packed = np.where(ok, at[a] * len(model.codes[b]) + at[b], -1)
                    place = _place(model.keys[x], packed)
                    if x < len(pairs):
                        value = np.where((place < 0) & (slots == k), missing[x], np.nan)
                    else:
                        value = np.array(batch.column(f"_p{p}").to_numpy(zero_copy_only=False))
                    hit = (place >= 0) & (slots >= 0)
                    value[hit] = model.means[x][place[hit], slots[hit]]
                    columns.append(pa.array(value, mask=np.isnan(value)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in plain], *columns], schema.names)

        return rows.mapInArrow(search, schema)
