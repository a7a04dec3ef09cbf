"""Near-duplicates by 64-bit fingerprints that differ in a few bits, found through Golay codewords.

A fingerprint is cut into three segments of 22, 21 and 21 bits, padded to the 23 bits of the code.
Four differing bits leave one of two cases (pigeonhole):

* a segment without a difference, and one of the other two has at most two: the key is the first
  segment whole and a codeword of the second, for each ordered pair of segments;
* else two segments differ in one bit each and the third in at most two, so one of three parts of the
  third has no difference: the key is a codeword of each of the two, where one of them is the nearest,
  and that part whole, for each pair of segments and each part.

So two fingerprints that link always meet under a key. Keys only bring fingerprints together: all
that meet are compared bit by bit, in blocks of two chunks of bounded size, and a block returns a
spanning forest of its links, never all pairs. Equal fingerprints are one from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from rowloom.llm import golay, words
from rowloom.llm.common import text_batches
from rowloom.llm.graph import components
from rowloom.session import settle

WORDS, SEED, BITS, MOST_BITS = 4, 42, 64, 4
#: (lowest bit, bits) of each segment
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: bits of the parts that a segment has three of
PART_BITS = 8
#: fingerprints of one chunk; a block compares two
CHUNK = 1_000
#: shingles whose bits are counted at a time
PART = 1 << 17


def fingerprints(column: pa.Array, size: int = WORDS) -> Iterator[np.ndarray]:
    """Fingerprints of all rows as unsigned 64-bit numbers, a slice of rows at a time.

    A bit is set if more than half of the row's ``size``-word shingles, repeats included, have it in their hash.
    """
    for first, last, data, offsets in words.slices(column):
        data = words.lower_ascii(data)
        starts, ends, firsts = words.spans(data, offsets, words.SPACED)
        # the words of a row joined by single spaces: each shingle is one run of bytes
        lengths = ends - starts
        places = np.concatenate([[0], np.cumsum(lengths + 1)])
        joined = np.full(places[-1], 0x20, np.uint8)
        inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        joined[np.repeat(places[:-1], lengths) + inside] = data[np.repeat(starts, lengths) + inside]
        counts = np.diff(firsts)
        shingles = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
        row = np.repeat(np.arange(last - first), shingles)
        begin = firsts[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
        end = np.minimum(begin + size, firsts[1:][row]) - 1
        raw, digest = memoryview(joined.tobytes()), xxhash.xxh64_intdigest
        ones = np.zeros((last - first, BITS), np.int64)
        for at in range(0, len(row), PART):
            part = slice(at, at + PART)
            low, high = places[begin[part]].tolist(), (places[end[part]] + lengths[end[part]]).tolist()
            hashes = np.array([digest(raw[a:b], SEED) for a, b in zip(low, high)], "<u8")
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            heads = np.flatnonzero(np.diff(row[part], prepend=-1))
            ones[row[part][heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
        set_ = np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little")
        yield np.ascontiguousarray(set_).view("<u8").reshape(-1).astype(np.uint64)


def _print(size: int):
    @F.arrow_udf(LongType())
    def fingerprint(column: pa.Array) -> pa.Array:
        found = list(fingerprints(column, size))
        return pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))

    return fingerprint


def meeting_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of each fingerprint, without repeats in a row."""
    whole = [(prints >> np.uint64(low)) & np.uint64((1 << bits) - 1) for low, bits in SEGMENTS]
    near = [golay.keys(x) for x in whole]
    rows, keys = [], []

    def put(tag: int, left: np.ndarray, right: np.ndarray, use: np.ndarray, part: np.ndarray) -> None:
        row, at = np.nonzero(use)
        rows.append(row)
        value = (left.astype(np.uint64) << np.uint64(golay.DATA_BITS)) | right.astype(np.uint64)
        value = np.broadcast_to(value, use.shape)[row, at] << np.uint64(PART_BITS)
        keys.append(value | part[row] | np.uint64(tag << 48))

    places = np.arange(golay.MOST)
    for i, j in permutations(range(len(SEGMENTS)), 2):
        codes, counts = near[j]
        put(3 * i + j, whole[i][:, None], codes, places < counts[:, None], np.zeros(len(prints), np.uint64))
    for i, j in combinations(range(len(SEGMENTS)), 2):
        k = 3 - i - j
        (mine, n), (codes, counts) = near[i], near[j]
        for at in range(3):
            part = (whole[k] >> np.uint64(at * PART_BITS)) & np.uint64((1 << PART_BITS) - 1)
            put(16 + 3 * k + at, mine[:, :1], codes, places < counts[:, None], part)
            put(16 + 3 * k + at, mine, codes[:, :1], (places > 0) & (places < n[:, None]), part)
    return np.concatenate(rows), np.concatenate(keys)


@F.arrow_udf(ArrayType(LongType()))
def _keys(prints: pa.Array) -> pa.Array:
    values = prints.to_numpy(zero_copy_only=False).view(np.uint64)
    row, keys = meeting_keys(values)
    order = np.argsort(row, kind="stable")
    offsets = np.searchsorted(row[order], np.arange(len(values) + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[order].view(np.int64)))


def block_links(prints: np.ndarray, side: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Links that span what is similar in a block: within it, or of side 0 with side 1 if it has both."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    two = len(right) > 0
    right = right if two else left
    group = np.arange(len(prints))
    for k, i in enumerate(left.tolist()):
        others = right if two else right[k + 1 :]
        others = others[np.bitwise_count(prints[others] ^ prints[i]) <= most]
        others = others[group[others] != group[i]]
        if len(others):
            _, first = np.unique(group[others], return_index=True)
            for j in others[first].tolist():
                yield i, j
            group[np.isin(group, group[others])] = group[i]


def _linker(most: int):
    """Rows arrive sorted by block, one block after another; only one block is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(part: np.ndarray) -> list[tuple[int, int]]:
            prints = part[:, 3].view(np.uint64)
            return [(int(part[i, 3]), int(part[j, 3])) for i, j in block_links(prints, part[:, 4], most)]

        def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "i", "j", "node", "side")], axis=1)
            cuts = np.flatnonzero(np.any(table[1:, :3] != table[:-1, :3], axis=1)) + 1
            found = []
            for part in np.split(table, cuts):
                if held and (held[0][0, :3] != part[0, :3]).any():
                    found += links(np.concatenate(held))
                    held = []
                held.append(part)
            yield batch_of(found)
        if held:
            yield batch_of(links(np.concatenate(held)))

    return run


def links(nodes: DataFrame, *, most: int = MOST_BITS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): a spanning set of the links between the distinct fingerprints ``node`` of ``nodes``."""
    keyed = nodes.select("node", F.explode(_keys(F.col("node"))).alias("key"))
    # one count per key, added up before it moves; keys of one fingerprint link nothing
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = settle(shared.select("key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")), "keys")
    met = keyed.join(shared.hint("merge"), "key").withColumn("chunk", F.expr("cast(pmod(xxhash64(node), chunks) as int)"))
    met = met.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    blocks = met.select(
        "key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node",
        (F.col("chunk") > F.col("other")).cast("int").alias("side"),
    )
    blocks = blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return blocks.mapInArrow(_linker(most), "a bigint, b bigint")


def fuzzy_duplicates(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", size: int = WORDS, most: int = MOST_BITS
) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each of ``docs``.

    Words are runs of anything but space and tab to return, A-Z lower-cased; a text's shingles are its runs of ``size``
    words, repeats included, joined by a space (a shorter text is one shingle). Rows link if their fingerprints (16 hex
    digits) differ in at most ``most`` bits (4 is the largest that the keys cover); a component's id is its smallest doc_id.
    Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows share a component.
    A row without an id links others like any row, but its id counts for none: the component is null only if no
    row in it has an id. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    if not 0 <= most <= MOST_BITS:
        raise ValueError(f"keys cover differences of 0 to {MOST_BITS} bits")
    text_batches(docs.sparkSession)
    printed = docs.select(F.col(id_column).alias("doc_id"), _print(size)(F.col(text_column)).alias("node"))
    printed = settle(printed, "fingerprints")
    nodes = settle(printed.groupBy("node").agg(F.min("doc_id").alias("least")), "nodes")
    linked = components(links(nodes, most=most))
    named = nodes.join(linked, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    final = settle(named.join(smallest, "component").select("node", "component_id"), "components")
    digits = F.lower(F.lpad(F.hex("node"), 16, "0"))
    # fingerprints that many rows share are split by the join of two plain shuffles
    return printed.join(final.hint("merge"), "node").select("doc_id", digits.alias("fingerprint"), "component_id")
