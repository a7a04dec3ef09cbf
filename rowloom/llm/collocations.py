"""Frequent phrases that hold together, from a weighted de Bruijn graph over words.

Nodes are runs of two and three words, an edge is a run of four from one node of three to the next.
Every word of a piece starts one longest gram: an edge, or near the piece's end a shorter one. Those
alone are counted; they move once, sorted by their first node. All other counts are flows:

* a node of three words occurs as often as its outgoing edges, plus the pieces that end with it;
* a node of two as often as its nodes of three, plus the pieces that end with it; a word likewise.

Only pairs of words that are frequent themselves can lie in a frequent phrase. A first scan counts pairs;
between the words of other pairs a piece is cut as if it ended there, which changes no count that matters
and keeps most grams of a corpus from moving at all. The frequent pairs are known by a filter of bounded size,
where a false hit costs a row and nothing else.

A node whose whole flow leaves along one edge lies on a unary path. It is compacted: the longer gram
has the same count, so it stands for the shorter one, which is not looked at again.

Grams are told apart by 64-bit hashes inside the hash of their first two words. A second scan finds
the words of the frequent ones: each carries 16 bits of a text that holds it, and only such texts give it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm import words
from rowloom.llm.common import text_batches
from rowloom.session import settle

WORDS = 4
UNKNOWN = "und"
SLICE_BYTES = 4 << 20
#: fewest and most bits of a filter (2**k), and bits for each key: beyond the most, more rows pass it than must
FILTER_BITS, KEY_BITS = (20, 28), 16
#: sums of a scan that are held before they go on
HELD_ROWS = 1 << 20
#: texts that first nodes of over 1/HOT of the grams are looked for in, and the tasks each of those is dealt to
SAMPLE_ROWS, HOT, SALTS = 2_000, 1_000, 64
#: grams that the sums are made of at a time
SUM_ROWS = 1 << 18

ENDS = words.char_class((0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"))
INSIDE = words.char_class((0x20, 0x20), (0x09, 0x09), inverted=True) & ~ENDS

_rng = np.random.default_rng(12)
_FACTORS = _rng.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LEVELS = _rng.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64)
_MIX = np.uint64(2_654_435_761)


class Grams:
    """The words of a slice of texts: hashes of the runs that start at each, and how many words its piece still has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, pairs: np.ndarray | None = None, most: int = WORDS) -> None:
        self.data = words.lower_ascii(data)
        self.starts, self.ends, firsts = words.spans(self.data, offsets, INSIDE)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
        n = len(self.starts)
        piece = np.cumsum(ENDS[self.data])[self.starts] if n else np.zeros(0, np.int64)
        new = np.ones(n, bool)
        new[1:] = (piece[1:] != piece[:-1]) | (self.row[1:] != self.row[:-1])
        self.lang = langs[self.row] * _FACTORS[WORDS]
        self.text = (words.span_hashes(self.data, offsets[:-1], offsets[1:]) & np.uint64(0xFFFF)).astype(np.int64)[self.row]
        single = words.span_hashes(self.data, self.starts, self.ends)
        padded, acc = np.concatenate([single, np.zeros(WORDS, np.uint64)]), self.lang.copy()
        self.keys = [words.mixed(acc ^ _LEVELS[0])]
        for m in range(most):
            acc = acc + padded[m : m + n] * _FACTORS[m]
            self.keys.append(words.mixed(acc ^ _LEVELS[m + 1]))
        if pairs is not None and n:
            new[1:] |= ~in_filter(pairs, self.keys[2][:-1])
        heads = np.append(np.flatnonzero(new), n)
        self.left = np.repeat(heads[1:], np.diff(heads)) - np.arange(n)

    def phrase(self, at: int, m: int) -> str:
        return b" ".join(self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(at, at + m)).decode()


def in_filter(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys & np.uint64(64 * len(table) - 1)
    return (table[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def key_filter(keys: DataFrame) -> np.ndarray:
    """One bit for each ``key``, by its low bits: at most 2**28 bits, gathered as words."""
    bits = min(max(FILTER_BITS[0], (KEY_BITS * keys.count()).bit_length()), FILTER_BITS[1])
    bit = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    found = keys.select(bit.alias("bit")).groupBy(F.expr("shiftright(bit, 6)").alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")
    ).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def gram_slices(batch: pa.RecordBatch, pairs: np.ndarray | None = None, most: int = WORDS) -> Iterator[tuple[int, Grams]]:
    """(first row, grams) of slices of a batch of (lang, text); a long text is cut between pieces."""
    data, offsets = words.buffers(batch.column("lang"))
    langs = words.span_hashes(data, offsets[:-1], offsets[1:])
    for first, last, data, offsets in words.slices(batch.column("text"), SLICE_BYTES):
        if len(data) <= 2 * SLICE_BYTES:
            yield first, Grams(data, offsets, langs[first:last], pairs, most)
            continue
        ends, at = np.flatnonzero(ENDS[data]), 0
        while at < len(data):
            k = int(np.searchsorted(ends, at + SLICE_BYTES))
            stop = int(ends[k]) + 1 if k < len(ends) else len(data)
            yield first, Grams(data[at:stop], np.array([0, stop - at]), langs[first:last], pairs, most)
            at = stop


class _Sums:
    """Counts of equal keys, held back until there are many rows: columns, their key, count and least text."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def push(self, by: np.ndarray, *columns: np.ndarray) -> bool:
        """Add rows; the last two columns are counts and texts. True if it is time to let go."""
        if len(by):
            order = np.argsort(by, kind="stable")
            heads = np.flatnonzero(np.append(True, by[order][1:] != by[order][:-1]))
            *keys, n, text = (c[order] for c in columns)
            self.held.append((by[order][heads], *(k[heads] for k in keys), np.add.reduceat(n, heads), np.minimum.reduceat(text, heads)))
            self.rows += len(heads)
        return self.rows >= HELD_ROWS

    def take(self) -> list[np.ndarray]:
        """The columns of all rows so far, without their key."""
        columns = [np.concatenate(c) for c in zip(*self.held)]
        self.held, self.rows = [], 0
        if columns:
            self.push(*columns)
            columns = list(self.held[0][1:])
            self.held, self.rows = [], 0
        return columns


GRAM = "a bigint, b bigint, c bigint, n bigint, text int"


def _gram_batch(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray, text: np.ndarray) -> pa.RecordBatch:
    arrays = [*(pa.array(x.view(np.int64)) for x in (a, b, c)), pa.array(n), pa.array(text.astype(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, ["a", "b", "c", "n", "text"])


def _longest(pairs):
    """Longest grams with counts, equal ones of a task added up as far as they are held.

    (a, b, c) are keys of the gram's first two, three and four words, zero where it is shorter. Flows of single
    words and of whole languages are summed here already and have a key in ``a`` only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, flows = _Sums(), _Sums()

        def one_key(columns: list[np.ndarray]) -> pa.RecordBatch:
            a, n, text = columns
            zero = np.zeros(len(a), np.uint64)
            return _gram_batch(a, zero, zero, n, text)

        for batch in batches:
            for _, g in gram_slices(batch, pairs.value):
                ones = np.ones(len(g.left), np.int64)
                for m in (0, 1):
                    if flows.push(g.keys[m], g.keys[m], ones, g.text):
                        yield one_key(flows.take())
                use = g.left >= 2
                a = g.keys[2][use]
                b = np.where(g.left >= 3, g.keys[3], 0)[use]
                c = np.where(g.left >= 4, g.keys[4], 0)[use]
                if grams.push(np.where(c != 0, c, np.where(b != 0, b, a)), a, b, c, ones[use], g.text[use]):
                    yield _gram_batch(*grams.take())
        if grams.rows:
            yield _gram_batch(*grams.take())
        if flows.rows:
            yield one_key(flows.take())

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and counts of all pairs of words."""
    sums = _Sums()

    def batch_of() -> pa.RecordBatch:
        key, n, _ = sums.take()
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    for batch in batches:
        for _, g in gram_slices(batch, most=2):
            key = g.keys[2][g.left >= 2]
            if sums.push(key, key, np.ones(len(key), np.int64), np.zeros(len(key), np.int64)):
                yield batch_of()
    if sums.rows:
        yield batch_of()


def frequent_pairs(texts: DataFrame, least: int) -> DataFrame:
    """(key) of the pairs of words that occur at least ``least`` times."""
    counts = texts.mapInArrow(_pairs, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    return settle(counts.where(F.col("n") >= least).select("key"), "pairs")


class _Level:
    """Sums of equal, adjacent keys over a stream of arrays; the last key waits for the next arrays."""

    def __init__(self, width: int) -> None:
        self.width, self.held = width, None

    def push(self, keys: np.ndarray, n: np.ndarray, text: np.ndarray, only: np.ndarray, end: bool):
        """Complete groups: keys, count, least text, parts, the key of the first part."""
        parts = np.ones(len(n), np.int64)
        if self.held is not None:
            keys, n, text, parts, only = (np.concatenate(x) for x in zip(self.held, (keys, n, text, parts, only)))
        self.held = None
        if not len(n):
            return keys, n, text, parts, only
        heads = np.flatnonzero(np.append(True, np.any(keys[1:] != keys[:-1], axis=1)))
        out = keys[heads], np.add.reduceat(n, heads), np.minimum.reduceat(text, heads), np.add.reduceat(parts, heads), only[heads]
        if not end:
            self.held = tuple(x[-1:] for x in out)
            out = tuple(x[:-1] for x in out)
        return out


FLOW = "key bigint, f bigint, text int, unary boolean"


def _flows(least: int, hot: list[int]):
    """Counts of all grams from longest grams in order; those under ``least`` only for hot first nodes, which have parts elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, threes, twos = _Level(3), _Level(2), _Level(1)
        hot_keys = np.array(sorted(hot), np.int64)

        def rows(key: np.ndarray, first: np.ndarray, f: np.ndarray, text: np.ndarray, unary: np.ndarray) -> pa.RecordBatch:
            use = (key != 0) & ((f >= least) | np.isin(first, hot_keys))
            return pa.RecordBatch.from_arrays(
                [pa.array(key[use]), pa.array(f[use]), pa.array(text[use].astype(np.int32)), pa.array(unary[use])], ["key", "f", "text", "unary"]
            )

        def settle_sums(held: list[pa.RecordBatch], end: bool) -> Iterator[pa.RecordBatch]:
            names = ("a", "b", "c", "n", "text")
            a, b, c, n, text = (np.concatenate([r.column(i).to_numpy(zero_copy_only=False) for r in held] or [np.zeros(0, np.int64)]) for i, _ in enumerate(names))
            keys, f, text, _, _ = edges.push(np.stack([a, b, c], 1), n, text, np.zeros(len(n), np.int64), end)
            yield rows(keys[:, 2], keys[:, 0], f, text, np.zeros(len(f), bool))
            keys, f, text, parts, only = threes.push(keys[:, :2], f, text, keys[:, 2], end)
            yield rows(keys[:, 1], keys[:, 0], f, text, (parts == 1) & (only != 0))
            keys, f, text, parts, only = twos.push(keys[:, :1], f, text, keys[:, 1], end)
            yield rows(keys[:, 0], keys[:, 0], f, text, (parts == 1) & (only != 0))

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(r.num_rows for r in held) >= SUM_ROWS:
                yield from settle_sums(held, False)
                held = []
        yield from settle_sums(held, True)

    return run


def hot_nodes(texts: DataFrame, pairs) -> list[int]:
    """First nodes with over 1/HOT of the grams of a sample of texts; only how work is dealt depends on them."""
    rows = texts.count()
    some = texts.sample(False, min(1.0, SAMPLE_ROWS / max(rows, 1)), seed=12).mapInArrow(_longest(pairs), GRAM).where("b != 0")
    counts = some.groupBy("a").agg(F.sum("n").alias("n"))
    bound = (some.agg(F.sum("n")).first()[0] or 0) / HOT
    return [r.a for r in counts.where(F.col("n") > F.lit(bound)).select("a").collect()]


def flows(texts: DataFrame, pairs, least: int, salts: int = SALTS) -> DataFrame:
    """(key, f, text, unary) of all languages, words and phrases that occur at least ``least`` times."""
    hot = hot_nodes(texts, pairs)
    salt = F.when(F.col("a").isin(hot), F.pmod(F.col("c"), F.lit(salts))).otherwise(F.lit(0)) if hot else F.lit(0)
    dealt = texts.mapInArrow(_longest(pairs), GRAM).repartition(F.col("a"), salt).sortWithinPartitions("a", "b", "c")
    parts = dealt.mapInArrow(_flows(least, hot), FLOW)
    # languages come in parts only here; a hot node's parts meet, one for each salt
    return parts.groupBy("key").agg(
        F.sum("f").alias("f"), F.min("text").alias("text"), (F.bool_and("unary") & (F.count("*") == 1)).alias("unary")
    ).where(F.col("f") >= least)


PHRASE = (
    "key bigint, lang string, phrase string, whole bigint, "
    "cuts array<struct<k:int,left:bigint,right:bigint>>, inner array<bigint>"
)


def _held_by(key, text):
    """Key of a gram in a text, for the filter of the last scan."""
    return key ^ (text * _MIX)


def _named(pairs, held):
    """Words, cuts and inner grams of the grams that pass the filter, each once a slice."""

    def passes(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
        return in_filter(held.value, _held_by(keys, text.astype(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang")
            for first, g in gram_slices(batch, pairs.value):
                out: list[tuple] = []
                signed = [k.view(np.int64) for k in g.keys]
                for m in range(2, WORDS + 1):
                    at = np.flatnonzero(g.left >= m)
                    at = at[passes(g.keys[m][at], g.text[at])]
                    at = at[np.unique(g.keys[m][at], return_index=True)[1]]
                    for i in at.tolist():
                        cuts = [{"k": k, "left": int(signed[k][i]), "right": int(signed[m - k][i + k])} for k in range(1, m)]
                        inner = [int(signed[w][i + s]) for w in range(2, m) for s in range(m - w + 1)]
                        out.append((int(signed[m][i]), langs[first + int(g.row[i])].as_py(), g.phrase(i, m), int(signed[0][i]), cuts, inner))
                columns = list(zip(*out)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _SCHEMA)], schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([
    ("key", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("whole", pa.int64()),
    ("cuts", pa.list_(pa.struct([("k", pa.int32()), ("left", pa.int64()), ("right", pa.int64())]))), ("inner", pa.list_(pa.int64())),
])


def collocations(
    docs: DataFrame, *, text_column: str = "text", lang_column: str = "lang", least: int = 30, share: int = 80, top: int = 2_000
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two to four words of each language.

    A-Z are lower-cased; texts are cut into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs.
    A phrase is a candidate if it occurs ``least`` times or more (a). Its score is that of its weakest cut into two
    parts that occur l and r times: floor(2000000 a / (l + r)), of equal ones the first cut. Candidates are left out
    if ``share`` per cent of their occurrences or more lie inside one longer candidate's count. Order: score, then a,
    descending, then the phrase by bytes; n is the number of words of the language. Arithmetic is exact.
    Null and empty texts have no words; a null language is ``und``, an empty one a language of its own. Repeated
    rows count again. Other columns are ignored; languages without candidates, and an empty table, give no rows.
    """
    spark = docs.sparkSession
    text_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_column).alias("text"))
    pairs = spark.sparkContext.broadcast(key_filter(frequent_pairs(texts, least)))
    frequent = settle(flows(texts, pairs, least), "flows")
    held = frequent.where("not unary").select(F.col("key").bitwiseXOR(F.col("text").cast("long") * F.lit(int(_MIX))).alias("key"))
    held = spark.sparkContext.broadcast(key_filter(held))
    counts = frequent.select("key", "f")
    named = texts.mapInArrow(_named(pairs, held), PHRASE).dropDuplicates(["key"])
    candidates = settle(named.join(frequent.where("not unary").select("key", F.col("f").alias("a")), "key"), "candidates")

    def exact(column, factor: int):
        return column.cast("decimal(20,0)") * F.lit(factor).cast("decimal(7,0)")

    longer = candidates.select(F.explode("inner").alias("key"), F.col("a").alias("f")).groupBy("key").agg(F.max("f").alias("longest"))
    alone = candidates.join(longer, "key", "left").where(
        F.col("longest").isNull() | (exact(F.col("longest"), 100) < exact(F.col("a"), share))
    )
    cut = alone.select("key", "a", F.explode("cuts").alias("cut")).select("key", "a", "cut.*")
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(counts.select(F.col("key").alias(side), F.col("f").alias(name)), side)
    cut = cut.withColumn("score", F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + r)"))
    weakest = cut.groupBy("key").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    scored = alone.select("key", "lang", "phrase", "whole", "a").join(weakest, "key")
    scored = scored.select("lang", "phrase", "whole", "a", "c.l", "c.r", "c.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    out = ranked.join(counts.select(F.col("key").alias("whole"), F.col("f").alias("n")), "whole")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
