"""Near-duplicates of texts by b-bit MinHash, confirmed on full shingle sets.

Minima of many hash functions make a signature. Runs of whole minima (bands) give candidates:
texts that share a band. Only the low bits of the minima are kept, packed into 64-bit words;
counting equal lanes and correcting for chance collisions estimates the similarity of two
candidates. Those whose estimate may stand for a link are clustered first, on signatures alone;
only then texts are read, and the pairs of a cluster are compared on full sets.

Pairs, of a band as of a cluster, are compared in blocks of two chunks of bounded size, and a block
returns a spanning forest of what it found, never all pairs. Texts with equal sets are one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm import words
from rowloom.llm.common import text_batches
from rowloom.llm.graph import components
from rowloom.session import settle

WORDS = 5
BANDS, BAND_ROWS = 24, 4
MINIMA = BANDS * BAND_ROWS
LOW_BITS = 4
LANES = 64 // LOW_BITS
#: documents and shingles of one chunk; a block compares two chunks
CHUNK = 400
CHUNK_SHINGLES = 400_000
#: how far below the threshold an estimate may lie, in standard deviations
SIGMAS = 6.0

_rng = np.random.default_rng(4)
_FACTORS = _rng.integers(1, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
_BAND_FACTORS = _rng.integers(1, 1 << 63, BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ONES = np.uint64(sum(1 << (LOW_BITS * i) for i in range(LANES)))


def shingle_sets(column: pa.Array, size: int, most: int = words.SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, sorted distinct shingle hashes, offsets per row)."""
    for first, last, data, offsets in words.slices(column, most):
        data = words.lower_ascii(data)
        starts, ends, firsts = words.spans(data, offsets, words.SPACED)
        values, rows = words.shingles(words.span_hashes(data, starts, ends), firsts, size)
        values, rows = words.distinct_by_row(values, rows)
        yield first, last, values, np.searchsorted(rows, np.arange(last - first + 1))


def minima(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over each row's set; rows must not be empty."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    hashed = np.empty_like(short)
    out = np.empty((MINIMA, len(bounds) - 1), np.uint32)
    for k in range(MINIMA):
        np.multiply(short, _FACTORS[k], out=hashed)
        np.add(hashed, _SHIFTS[k], out=hashed)
        np.minimum.reduceat(hashed, bounds[:-1], out=out[k])
    return out.T


def packed(mins: np.ndarray) -> np.ndarray:
    """The low bits of all minima, LANES to a 64-bit word."""
    low = (mins.astype(np.uint64) & np.uint64((1 << LOW_BITS) - 1)).reshape(len(mins), MINIMA // LANES, LANES)
    return np.bitwise_or.reduce(low << (np.arange(LANES, dtype=np.uint64) * np.uint64(LOW_BITS)), axis=2)


def estimates(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimated similarity of packed signatures, for each pair of rows; chance collisions are corrected."""
    unequal = np.zeros((len(left), len(right)), np.int64)
    for w in range(left.shape[1]):
        x = left[:, w, None] ^ right[None, :, w]
        for _ in range(LOW_BITS.bit_length() - 1):
            x |= x >> np.uint64(1 << _)
        unequal += np.bitwise_count(x & _ONES)
    chance = 2.0**-LOW_BITS
    return ((1 - unequal / MINIMA) - chance) / (1 - chance)


def margin(similarity: float) -> float:
    """How far an estimate may fall below the similarity it stands for."""
    chance = 2.0**-LOW_BITS
    equal = chance + (1 - chance) * similarity
    return SIGMAS * np.sqrt(equal * (1 - equal) / MINIMA) / (1 - chance)


SKETCH = "struct<n_shingles:bigint,node:bigint,bands:array<bigint>,signature:array<bigint>>"


def _sketch(size: int):
    @F.arrow_udf(SKETCH)
    def sketch(column: pa.Array) -> pa.Array:
        counts, nodes, bands, signatures = [], [], [], []
        for first, last, values, bounds in shingle_sets(column, size, 256 << 10):
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            mins = minima(values, np.append(bounds[full], len(values))) if len(full) else np.zeros((0, MINIMA), np.uint32)
            keys = (mins.reshape(len(mins), BANDS, BAND_ROWS).astype(np.uint64) * _BAND_FACTORS).sum(2, dtype=np.uint64)
            keys = words.mixed(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            words_ = packed(mins).view(np.int64)
            at = 0
            for r in range(last - first):
                part = values[bounds[r] : bounds[r + 1]]
                counts.append(len(part))
                nodes.append(int.from_bytes(hashlib.blake2b(part.tobytes(), digest_size=8).digest(), "little", signed=True) if len(part) else None)
                bands.append(keys[at] if sizes[r] else [])
                signatures.append(words_[at] if sizes[r] else [])
                at += int(sizes[r] > 0)
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.list_(pa.int64()))],
            ["n_shingles", "node", "bands", "signature"],
        )

    return sketch


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def block_links(texts: pa.Array, signatures: np.ndarray, side: np.ndarray, size: int, percent: int) -> Iterator[tuple[int, int]]:
    """Links that span the similar rows of a block: pairs within it, or of side 0 with side 1 if it has both."""
    parts = list(shingle_sets(texts, size))
    sets = [values[bounds[r] : bounds[r + 1]] for first, last, values, bounds in parts for r in range(last - first)]
    lengths = np.array([len(s) for s in sets])
    two = bool(side.any())
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if two else left
    if not len(left) or not len(right):
        return
    _, ids = np.unique(np.concatenate([sets[i] for i in right] + [sets[i] for i in left]), return_inverse=True)
    right_bounds = np.concatenate([[0], np.cumsum(lengths[right])])
    right_ids, left_ids = ids[: right_bounds[-1]], ids[right_bounds[-1] :]
    left_bounds = np.concatenate([[0], np.cumsum(lengths[left])])
    likely = estimates(signatures[left], signatures[right]) >= percent / 100 - margin(percent / 100)
    mark = np.zeros(int(ids.max(initial=0)) + 1, bool)
    forest = _Forest(len(sets))
    for k, i in enumerate(left.tolist()):
        may = likely[k] & (100 * np.minimum(lengths[i], lengths[right]) >= percent * np.maximum(lengths[i], lengths[right]))
        if not two:
            may[: k + 1] = False
        if not may.any():
            continue
        root = forest.find(i)
        may &= np.array([forest.find(j) != root for j in right.tolist()])
        if not may.any():
            continue
        mine = left_ids[left_bounds[k] : left_bounds[k + 1]]
        mark[mine] = True
        shared = np.add.reduceat(mark[right_ids], right_bounds[:-1], dtype=np.int64)
        mark[mine] = False
        for j in right[may & (100 * shared >= percent * (lengths[i] + lengths[right] - shared))].tolist():
            if forest.join(i, j):
                yield i, j


def block_candidates(signatures: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs that span the rows of a block whose estimates may stand for ``percent``."""
    two = bool(side.any())
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if two else left
    group = np.arange(len(signatures))
    for k, i in enumerate(left.tolist()):
        others = right if two else right[k + 1 :]
        others = others[group[others] != group[i]]
        if not len(others):
            continue
        near = estimates(signatures[i : i + 1], signatures[others])[0] >= percent / 100 - margin(percent / 100)
        others = others[near]
        if len(others):
            _, first = np.unique(group[others], return_index=True)
            for j in others[first].tolist():
                yield i, j
            group[np.isin(group, group[others])] = group[i]


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(len(flat), -1)


def _blocks(pairs):
    """Pairs of nodes from blocks (cluster, i, j) that arrive sorted, one after another; only one is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def links(block: pa.Table) -> list[tuple[int, int]]:
            nodes = block.column("node").to_numpy()
            return [(nodes[i], nodes[j]) for i, j in pairs(block, block.column("side").to_numpy())]

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        def key(table: pa.Table, row: int) -> tuple:
            return tuple(table.column(c)[row].as_py() for c in ("cluster", "i", "j"))

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            columns = [table.column(c).to_numpy() for c in ("cluster", "i", "j")]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            edges = [0, *change.tolist(), table.num_rows]
            found = []
            for start, end in zip(edges, edges[1:]):
                part = table.slice(start, end - start)
                if held and key(held[0], 0) != key(part, 0):
                    found += links(pa.concat_tables(held))
                    held = []
                held.append(part)
            yield batch_of(found)
        if held:
            yield batch_of(links(pa.concat_tables(held)))

    return run


def _dealt(members: DataFrame, sizes: DataFrame, *carried: str) -> DataFrame:
    """Members of a cluster in blocks of two chunks: (cluster, i, j, side, node, ...), by the table (cluster, chunks)."""
    dealt = members.join(sizes.hint("merge"), "cluster").withColumn("chunk", F.expr("cast(pmod(xxhash64(node), chunks) as int)"))
    paired = dealt.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    return paired.select(
        "cluster", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
        (F.col("chunk") > F.col("other")).cast("int").alias("side"), "node", *carried,
    )


def _linked(blocks: DataFrame, pairs) -> DataFrame:
    return blocks.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(_blocks(pairs), "a bigint, b bigint")


def text_tag(column: str) -> Column:
    """Tells texts apart; null is empty."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def grouped(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", size: int = WORDS, percent: int = 85
) -> DataFrame:
    """(doc_id, tag, n_shingles, root, component_id), a row for each of ``docs``.

    ``root`` is the same number for all rows of a component, null without shingles; ``tag`` is ``text_tag``.
    """
    spark = docs.sparkSession
    text_batches(spark)
    texts = docs.select(F.col(id_column).alias("doc_id"), text_tag(text_column).alias("tag"), F.col(text_column).alias("text"))
    sketched = settle(texts.select("doc_id", "tag", _sketch(size)(F.col("text")).alias("s")).select("doc_id", "tag", "s.*"), "sketches")
    full = sketched.where("n_shingles > 0")
    nodes = full.groupBy("node").agg(
        F.min("doc_id").alias("least"), F.min("tag").alias("tag"), F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"), F.first("signature").alias("signature"),
    )
    nodes = settle(nodes, "nodes")
    banded = nodes.select("node", F.explode("bands").alias("cluster"))
    # written first: a join of two plain shuffles lets Spark split the rows of a hot band
    bands = settle(
        banded.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "bands"
    )
    met = _dealt(banded, bands).join(nodes.select("node", "signature").hint("merge"), "node")
    candidates = _linked(met, lambda block, side: block_candidates(_signatures(block.column("signature")), side, percent))
    clusters = components(candidates).withColumnRenamed("component", "cluster")
    # large clusters are cut into chunks, by rows and by shingles
    members = settle(clusters.join(nodes.select("node", "tag", "n_shingles", "signature").hint("merge"), "node"), "members")
    sizes = members.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n_shingles") / CHUNK_SHINGLES)).cast("int").alias("chunks")
    )
    blocks = _dealt(members, sizes, "tag", "signature")
    # the members grow with the documents, so they are never broadcast: one plan at every size
    with_text = texts.select("tag", "text").join(members.select("tag").hint("merge"), "tag", "left_semi").dropDuplicates(["tag"])

    def confirmed(block: pa.Table, side: np.ndarray) -> Iterator[tuple[int, int]]:
        return block_links(block.column("text").combine_chunks(), _signatures(block.column("signature")), side, size, percent)

    linked = components(_linked(blocks.join(with_text, "tag"), confirmed))
    named = nodes.select("node", "least").join(linked, "node", "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    final = settle(named.join(smallest, "root").select("node", "root", "component_id"), "final")
    # rows without shingles have no node, so they are not joined
    bare = sketched.where("n_shingles = 0").select("doc_id", "tag", "n_shingles", F.lit(None).cast("bigint").alias("root"), F.col("doc_id").alias("component_id"))
    return full.select("doc_id", "tag", "n_shingles", "node").join(final.hint("merge"), "node").drop("node").select(*bare.columns).unionByName(bare)


def near_duplicates(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", size: int = WORDS, percent: int = 85
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each of ``docs``.

    Words are runs of anything but space and tab to return, A-Z lower-cased; a document's set are its distinct
    ``size``-word shingles, or its whole sequence if that is shorter. Two documents are linked if 100 times
    the common shingles are at least ``percent`` times the united ones; a component's id is its smallest doc_id.
    Null, empty and blank texts have no shingles and are components of their own. Repeated rows share a
    component, and so do different texts under one id only if they are linked. Rows without an id link like any
    row, but their id counts for none (the component is null if all lack an id) and they are never ``kept``. An
    empty table gives no rows; other columns are ignored.

    Shingles are 64-bit hashes. A link of similarity 0.85 shares no band with probability 2e-8, one of 0.80 with
    3e-6, and none is dropped for another reason: groups of any size are compared whole.
    """
    out = grouped(docs, id_column=id_column, text_column=text_column, size=size, percent=percent)
    return out.select("doc_id", "n_shingles", "component_id").withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )


def one_each(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", size: int = WORDS, percent: int = 80
) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id, rows without an id last, then by text.

    Different texts under one id are different rows. Rows without shingles all stay, but of rows that repeat both id
    and text, one does.
    """
    names = {c.lower() for c in docs.columns}
    mine = {x: next(n for n in (f"_{x}{k or ''}" for k in range(len(names) + 1)) if n not in names) for x in ("id", "tag")}

    def name(column: str):
        return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("-"))

    found = grouped(docs, id_column=id_column, text_column=text_column, size=size, percent=percent)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag"))
    first = found.where("root is not null").groupBy("root").agg(best.alias("row")).select("row.doc_id", "row.tag")
    stays = first.unionByName(found.where("root is null").select("doc_id", "tag"))
    stays = settle(stays.select(name("doc_id").alias(mine["id"]), F.col("tag").alias(mine["tag"])).distinct(), "stays")
    keyed = docs.withColumns({mine["id"]: name(id_column), mine["tag"]: text_tag(text_column)})
    kept = keyed.join(stays.hint("merge"), list(mine.values()), "left_semi")
    return kept.dropDuplicates(list(mine.values())).select(*[F.col(f"`{c}`") for c in docs.columns])
