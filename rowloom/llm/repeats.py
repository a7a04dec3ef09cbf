"""Repeated byte strings by external induced suffix sorting.

A window is ``length`` bytes. Its anchor is the place of the smallest hash among its grams, so
equal windows have equal anchors at equal offsets. Anchors are the sampled suffixes: about two for each ``length`` bytes.

1. Anchors whose gram occurs once anywhere are settled: their windows are unique.
2. Anchors with the same gram and the same surroundings collapse to one tuple with a count.
3. The other tuples are sorted by gram and following bytes. The sort is Spark's external one: runs go to
   disk and are merged through a priority queue, so a shard may be far larger than memory. Neighbours in
   that order give common-prefix values.
4. From the sorted anchors the order of the suffixes that start 1, 2, 3 ... bytes earlier is induced: a stable
   partition by the preceding byte keeps the order of the suffixes behind it, and the common prefix of new
   neighbours is the least value between them in the old order. A window repeats if the
   common prefix with a neighbour spans it.

Grams with more distinct surroundings than one task should hold are settled by counting window hashes instead.

Windows of two lengths are settled in one pass: anchors are those of the shorter length, surroundings and following
bytes reach as far as the longer one, or to the end of the text.
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
from rowloom.session import settle

LENGTH = 400
GRAM = 32
#: distinct surroundings of one gram that a task sorts; grams with more are counted by window
HOT = 20_000
#: tuples that a task sorts at once, in whole groups
BATCH_TUPLES = 20_000

_PLACE_BITS = np.uint64(28)
_PLACE = np.uint64((1 << 28) - 1)


class _Hashes:
    """Hashes of any spans of a run of bytes, from prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words._BYTE_CODES[data] * words.powers(words._BASE, n), out=self.sums[1:])
        self.inverse = words.powers(words._BASE_INVERSE, n + 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return words.mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])

    def all_of(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:-size]) * self.inverse[:n]


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, ~np.uint64(0))
    padded[:n] = values
    grid = padded.reshape(rows, width)
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(grid, axis=1).ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, short: int) -> dict[str, np.ndarray]:
    """Per anchor of the windows of ``short`` bytes: row, place in the row, least and largest distance of its windows'
    starts before it, distance to the end of its surroundings, hashes of its gram and of its surroundings (all bytes
    of its windows, and of those of ``length`` bytes that start with them as far as the row goes)."""
    n, width = len(data), short - gram + 1
    sizes = np.diff(offsets)
    names = ("row", "s", "dmin", "dmax", "reach", "key", "region")
    empty = {k: np.zeros(0, np.uint64 if k in ("key", "region") else np.int64) for k in names}
    if not (sizes >= short).any():
        return empty
    if n > int(_PLACE):
        raise ValueError(f"a text of {n} bytes is longer than this operator's {int(_PLACE)}")
    hashes = _Hashes(data)
    grams = hashes.all_of(gram)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    least = _sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), width)
    # window starts that leave room for a window in their row
    valid = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(sizes >= short)
    valid[offsets[long]] = 1
    valid[offsets[long] + sizes[long] - short + 1] -= 1
    starts = np.flatnonzero(np.cumsum(valid)[: len(least)] > 0)
    place = (least[starts] & _PLACE).astype(np.int64)
    change = np.ones(len(starts), bool)
    change[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(starts)) - 1
    low, high, s = starts[first], starts[last], place[first]
    row = np.searchsorted(offsets, s, side="right") - 1
    end = np.minimum(high + length, offsets[row + 1])
    region = hashes.spans(low, end) ^ words.mixed((s - low).astype(np.uint64) + np.uint64(1))
    return {
        "row": row, "s": s - offsets[row], "dmin": s - high, "dmax": s - low, "reach": end - s,
        "key": words.mixed(grams[s]), "region": region,
    }


ANCHORS = (
    "struct<n_bytes:bigint,sha:string,s:array<int>,dmin:array<int>,dmax:array<int>,reach:array<int>,key:array<bigint>,"
    "region:array<bigint>,times:array<int>,local:array<struct<a:int,b:int,c:int>>>"
)
_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("c", pa.int32())]))


def _anchor_column(text: Column, length: int, gram: int, short: int) -> Column:
    """Distinct anchors of each text, how often each occurs in it, and the spans of those that occur twice."""

    @F.arrow_udf(ANCHORS)
    def find(column: pa.Array) -> pa.Array:
        kept: dict[str, list[np.ndarray]] = {k: [] for k in ("s", "dmin", "dmax", "reach", "key", "region", "times")}
        counts, sizes, digests, local = [], [], [], []
        for first, last, data, offsets in words.slices(column, 1 << 20):
            found = anchors(data, offsets, length, gram, short)
            row = found["row"]
            order = np.lexsort((found["s"], found["region"], found["key"], row))
            same = np.zeros(len(order), bool)
            for name in ("row", "key", "region"):
                v = found[name][order]
                same[1:] |= v[1:] != v[:-1]
            new = same.copy()
            new[:1] = True
            group = np.cumsum(new) - 1
            times = np.bincount(group, minlength=0)
            heads = order[new]
            for name in ("s", "dmin", "dmax", "reach", "key", "region"):
                kept[name].append(found[name][heads])
            kept["times"].append(times)
            counts.append(np.bincount(row[heads], minlength=last - first))
            twice = order[times[group] > 1] if len(order) else order
            spans: dict[int, list[dict]] = {}
            for i in twice.tolist():
                s, dmin, dmax, reach = (int(found[k][i]) for k in ("s", "dmin", "dmax", "reach"))
                spans.setdefault(int(row[i]), []).append({
                    "a": s - dmax, "b": s + reach if dmax + reach >= length else None, "c": s - dmin + short if short < length else None,
                })
            for r in range(last - first):
                raw = data[offsets[r] : offsets[r + 1]]
                sizes.append(len(raw))
                digests.append(hashlib.sha256(raw.tobytes()).hexdigest())
                local.append(_shorter(spans[r]) if r in spans else [])
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32) if counts else np.zeros(1, np.int32)
        whole = {k: np.concatenate(v) if v else np.zeros(0) for k, v in kept.items()}
        lists = [
            pa.ListArray.from_arrays(bounds, pa.array(whole[k].astype(np.int32))) for k in ("s", "dmin", "dmax", "reach")
        ] + [pa.ListArray.from_arrays(bounds, pa.array(whole[k].astype(np.uint64).view(np.int64))) for k in ("key", "region")]
        times = pa.ListArray.from_arrays(bounds, pa.array(whole["times"].astype(np.int32)))
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), *lists, times, pa.array(local, _SPANS)],
            ["n_bytes", "sha", "s", "dmin", "dmax", "reach", "key", "region", "times", "local"],
        )

    return find(text)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans, sorted; spans that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _shorter(spans: list[dict]) -> list[dict]:
    """The same unions of (a, b) and of (a, c) in as few spans."""
    return [{"a": x, "b": None, "c": None, k: y} for k in ("b", "c") for x, y in merged([(s["a"], s[k]) for s in spans if s[k] is not None])]


def induced(
    group: np.ndarray, left: np.ndarray, right: np.ndarray, room: np.ndarray, dmin: np.ndarray, dmax: np.ndarray, lengths: list[int]
) -> np.ndarray:
    """Which windows of each length repeat: a flag per length, tuple and distance before the anchor.

    Tuples are sorted by group and following bytes ``right`` (``room`` of them valid); ``left`` holds the preceding
    bytes, nearest first.
    """
    n = len(group)
    flags = np.zeros((len(lengths), n, int(dmax.max(initial=0)) + 1), bool)
    common = np.zeros(n, np.int64)
    equal = right[1:] == right[:-1]
    run = np.where(equal.all(1), right.shape[1], equal.argmin(1)) if n > 1 else np.zeros(0, np.int64)
    common[1:] = np.minimum(np.minimum(run, room[1:]), room[:-1])
    common[0] = -1
    common[1:][group[1:] != group[:-1]] = -1
    index, classes = np.arange(n), group.copy()
    for d in range(flags.shape[2]):
        best = common.copy()
        best[:-1] = np.maximum(best[:-1], common[1:])
        inside = (dmin[index] <= d) & (dmax[index] >= d)
        for k, length in enumerate(lengths):
            flags[k, index[inside & (best + d >= length)], d] = True
        p = np.flatnonzero((dmax[index] > d) & (best + dmax[index] >= min(lengths)))
        if not len(p):
            break
        key = (classes[p] << 8) | left[index[p], d]
        order = np.argsort(key, kind="stable")
        q, key = p[order], key[order]
        new = np.ones(len(q), bool)
        new[1:] = key[1:] != key[:-1]
        value = common[q]
        gap = np.flatnonzero(~new[1:] & (q[1:] != q[:-1] + 1)) + 1
        if len(gap):
            bounds = np.empty(2 * len(gap), np.int64)
            bounds[0::2], bounds[1::2] = q[gap - 1] + 1, q[gap] + 1
            value[gap] = np.minimum.reduceat(np.append(common, 0), bounds)[::2]
        value[new] = -1
        index, classes, common = index[q], np.cumsum(new) - 1, value
    return flags


def _matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = words.buffers(column)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width), np.uint8)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(data)) - offsets[:-1][row]] = data
    return out, sizes


def _sorter(length: int, gram: int, short: int):
    """Tuples arrive sorted by gram and following bytes; whole groups are induced together."""

    def repeats(table: pa.Table) -> pa.RecordBatch:
        key = table.column("key").to_numpy()
        dmin, dmax, s = (table.column(c).to_numpy().astype(np.int64) for c in ("dmin", "dmax", "s"))
        left, _ = _matrix(table.column("left"), short - gram + 1)
        right, room = _matrix(table.column("right"), length)
        group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]).astype(np.int64)
        flags = induced(group, left, right, room, dmin, dmax, [length, short] if short < length else [length])
        flags[:, table.column("times").to_numpy() > 1] = False  # known to repeat already
        edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (0, 0), (1, 1))), axis=2)
        kind, t, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[2]
        ends = [pa.array((s[t] - low + size).astype(np.int32), mask=kind != k) for k, size in enumerate((length, short))]
        return pa.RecordBatch.from_arrays(
            [table.column("doc").combine_chunks().take(pa.array(t)), table.column("tag").combine_chunks().take(pa.array(t)),
             pa.array((s[t] - high + 1).astype(np.int32)), *ends],
            ["doc", "tag", "a", "b", "c"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held.append(table)
            rows += table.num_rows
            if rows < BATCH_TUPLES:
                continue
            whole = pa.concat_tables(held)
            key = whole.column("key").to_numpy()
            change = np.flatnonzero(key[1:] != key[:-1])
            if not len(change):
                continue
            cut = int(change[-1]) + 1
            yield repeats(whole.slice(0, cut))
            held, rows = [whole.slice(cut)], whole.num_rows - cut
        if rows:
            yield repeats(pa.concat_tables(held))

    return run


def _surroundings(length: int):
    """Preceding bytes (nearest first) and following bytes of the anchors listed for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.binary())
            out: list[tuple] = []
            for r, listed in enumerate(batch.column("listed").to_pylist()):
                raw = text[r].as_py()
                doc, tag = batch.column("doc")[r].as_py(), batch.column("tag")[r].as_py()
                for x in listed:
                    s = x["s"]
                    before = raw[s - x["dmax"] : s][::-1]
                    out.append((x["key"], doc, tag, s, x["dmin"], x["dmax"], x["times"], before, raw[s : s - x["dmin"] + length]))
                    if len(out) >= 2_000:
                        yield _tuples(out)
                        out = []
            if out:
                yield _tuples(out)

    return run


TUPLE = "key bigint, doc bigint, tag bigint, s int, dmin int, dmax int, times bigint, left binary, right binary"


def _tuples(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(9)], [c.split()[0] for c in TUPLE.split(", ")])


def _window_hashes(lengths: list[int]):
    """A row per window of each length of the anchors listed for each text: gram, length, hash, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.binary())
            for r, listed in enumerate(batch.column("listed").to_pylist()):
                raw = np.frombuffer(text[r].as_py(), np.uint8)
                hashes = _Hashes(raw)
                for x, length in ((x, length) for x in listed for length in lengths):
                    starts = np.arange(x["s"] - x["dmax"], min(x["s"] - x["dmin"], len(raw) - length) + 1)
                    n = len(starts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, x["key"])), pa.array(np.full(n, length, np.int32)),
                         pa.array(hashes.spans(starts, starts + length).view(np.int64)),
                         pa.array(np.full(n, batch.column("doc")[r].as_py())), pa.array(np.full(n, batch.column("tag")[r].as_py())),
                         pa.array(starts.astype(np.int32)), pa.array(np.full(n, x["times"]))],
                        ["key", "size", "window", "doc", "tag", "start", "times"],
                    )

    return run


def repeated_spans(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT,
    short: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Texts (doc, tag, n_bytes, sha) and the spans (doc, tag, starts, ends, short_starts, short_ends) of their bytes
    that some repeated ``length``-byte string covers; ``tag`` is a hash of the text and tells rows without an id apart.

    The same document counts as another place, and overlaps count. Spans of a text are sorted, disjoint and
    not adjacent. Texts without a repeat have no row in the second table. With ``short``, below ``length``, the last two
    columns hold the spans of strings of so many bytes; without, they are empty.
    """
    spark = docs.sparkSession
    text_batches(spark)
    lengths = [length, short] if short else [length]
    short = short or length
    if not gram <= short <= length:
        raise ValueError(f"strings of {short} bytes: at least {gram} and at most {length} are possible")
    # rows without an id share the smallest long
    base = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63))).alias("doc"),
        F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("tag"), F.col(text_column).alias("text"),
    )
    found = settle(base.select("doc", "tag", _anchor_column(F.col("text"), length, gram, short).alias("f")).select("doc", "tag", "f.*"), "anchors")
    zipped = F.arrays_zip("s", "dmin", "dmax", "reach", "key", "region", "times")
    each = found.select("doc", "tag", F.explode(zipped).alias("x")).select("doc", "tag", "x.*")
    # narrow sides are written first: a join of two plain shuffles lets Spark split the rows of a hot gram. They grow
    # with the documents, so they are never broadcast: one plan at every size
    common = settle(each.groupBy("key").agg(F.sum("times").alias("n")).where("n > 1").select("key"), "common")
    shared = settle(each.join(common.hint("merge"), "key"), "shared")
    same = ["key", "region", "dmin", "dmax", "reach"]
    regions = settle(
        shared.groupBy(*same).agg(F.sum("times").alias("times"), F.min(F.struct("doc", "tag", "s")).alias("at")).select(*same, "times", "at.*"), "regions"
    )
    # spans are (a, b) of a string of the whole length, (a, c) of a short one; either end may be null
    known = shared.join(regions.where("times > 1").select(*same), same).select(
        "doc", "tag", (F.col("s") - F.col("dmax")).alias("a"),
        F.when(F.col("dmax") + F.col("reach") >= length, F.col("s") + F.col("reach")).alias("b"),
        (F.col("s") - F.col("dmin") + F.lit(short if short < length else None).cast("int")).alias("c"),
    )
    kinds = settle(regions.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "kinds")
    several = regions.join(kinds.hint("merge"), "key").withColumn("hot", F.col("n") > hot)
    listed = settle(
        several.groupBy("doc", "tag").agg(F.collect_list(F.struct("key", "s", "dmin", "dmax", "times", "hot")).alias("listed")), "listed"
    )
    with_text = settle(
        base.join(listed, ["doc", "tag"]).dropDuplicates(["doc", "tag"]).select("doc", "tag", "text", "listed"), "listed-texts"
    )
    cold = with_text.withColumn("listed", F.filter("listed", lambda x: ~x["hot"])).where(F.size("listed") > 0)
    tuples = cold.mapInArrow(_surroundings(length), TUPLE)
    sorted_ = tuples.repartition("key").sortWithinPartitions("key", "right")
    induced_spans = sorted_.mapInArrow(_sorter(length, gram, short), "doc bigint, tag bigint, a int, b int, c int")
    warm = with_text.withColumn("listed", F.filter("listed", lambda x: x["hot"])).where(F.size("listed") > 0)
    windows = warm.mapInArrow(_window_hashes(lengths), "key bigint, size int, window bigint, doc bigint, tag bigint, start int, times bigint")
    windows = settle(windows, "windows")
    place = ["key", "size", "window"]
    twice = windows.groupBy(*place).agg(F.sum("times").alias("n")).where("n > 1").select(*place)
    end = F.col("start") + F.col("size")
    counted = windows.where("times = 1").join(twice, place).select(
        "doc", "tag", F.col("start").alias("a"), F.when(F.col("size") == length, end).alias("b"), F.when(F.col("size") < length, end).alias("c")
    )
    local = found.select("doc", "tag", F.explode("local").alias("x")).select("doc", "tag", "x.*")
    spans = known.unionByName(local).unionByName(induced_spans).unionByName(counted)
    return found.select("doc", "tag", "n_bytes", "sha"), settle(_union(spans), "spans")


def _union(spans: DataFrame) -> DataFrame:
    """(doc, tag, starts, ends, short_starts, short_ends): the unions of each text's spans, sorted."""

    @F.arrow_udf("struct<starts:array<int>,ends:array<int>,short_starts:array<int>,short_ends:array<int>>")
    def join(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        starts, lists = a.to_pylist(), []
        for column in (b, c):
            rows = [merged([(x, y) for x, y in zip(p, q) if y is not None]) for p, q in zip(starts, column.to_pylist())]
            lists += [pa.array([[s[k] for s in spans] for spans in rows], pa.list_(pa.int32())) for k in (0, 1)]
        return pa.StructArray.from_arrays(lists, ["starts", "ends", "short_starts", "short_ends"])

    # repeated rows give the same spans; each is gathered once
    gathered = spans.distinct().groupBy("doc", "tag").agg(F.collect_list(F.struct("a", "b", "c")).alias("x"))
    return gathered.select("doc", "tag", join(F.col("x.a"), F.col("x.b"), F.col("x.c")).alias("u")).select("doc", "tag", "u.*")


def removed(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT,
    short: int | None = None, least_words: int = 0,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each of ``docs``.

    Texts are UTF-8 bytes, null is empty; a text shorter than ``length`` keeps everything. Repeated rows are
    other places, so their bytes go in all of them. An empty table gives no rows; other columns are ignored.

    With ``short``, two columns follow: ``n_passages``, the runs of bytes that repeated strings of ``short`` bytes cover and
    that touch ``least_words`` words (between spaces and tab to return) or more, and ``passage_bytes``, their bytes.
    These stay in the text unless strings of ``length`` bytes cover them.
    """
    texts, spans = repeated_spans(docs, id_column=id_column, text_column=text_column, length=length, gram=gram, hot=hot, short=short)

    @F.arrow_udf("struct<sha:string,n_passages:bigint,passage_bytes:bigint>")
    def kept(text: pa.Array, starts: pa.Array, ends: pa.Array, short_starts: pa.Array, short_ends: pa.Array) -> pa.Array:
        out = []
        for raw, a, b, c, d in zip(text.cast(pa.binary()), *(x.to_pylist() for x in (starts, ends, short_starts, short_ends))):
            raw, digest, at = raw.as_py(), hashlib.sha256(), 0
            for x, y in zip(a, b):
                digest.update(raw[at:x])
                at = y
            digest.update(raw[at:])
            long = [y - x for x, y in zip(c, d) if len(raw[x:y].split()) >= least_words]
            out.append((digest.hexdigest(), len(long), sum(long)))
        columns = [pa.array([x[k] for x in out], pa.int64() if k else pa.string()) for k in range(3)]
        return pa.StructArray.from_arrays(columns, ["sha", "n_passages", "passage_bytes"])

    base = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63))).alias("doc"),
        F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("tag"), F.col(text_column).alias("text"),
    )
    gone = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda acc, x: acc + x["ends"] - x["starts"])
    measured = spans.withColumn("n_removed", gone).withColumn("n_spans", F.size("starts").cast("long"))
    # only texts that keep a part or have short spans need their bytes again
    sized = texts.dropDuplicates(["doc", "tag"]).join(measured, ["doc", "tag"])
    lists = ["starts", "ends", "short_starts", "short_ends"]
    part = sized.where("n_removed < n_bytes or size(short_starts) > 0").select("doc", "tag", *lists)
    cut = base.join(part, ["doc", "tag"]).dropDuplicates(["doc", "tag"]).select("doc", "tag", kept(*map(F.col, ["text", *lists])).alias("kept"))
    out = texts.join(measured.select("doc", "tag", "n_removed", "n_spans"), ["doc", "tag"], "left").join(cut, ["doc", "tag"], "left")
    n = F.coalesce("n_removed", F.lit(0).cast("long"))
    passages = [F.coalesce(f"kept.{c}", F.lit(0).cast("long")).alias(c) for c in ("n_passages", "passage_bytes")] if short else []
    return out.select(
        F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias("doc_id"), "n_bytes", n.alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.when(n == 0, F.col("sha")).otherwise(F.coalesce("kept.sha", F.lit(hashlib.sha256().hexdigest()))).alias("kept_sha256"),
        *passages,
    )


def remove(docs: DataFrame, *, id_column: str = "doc_id", length: int = LENGTH, gram: int = GRAM, least_words: int = 0) -> DataFrame:
    """``docs`` without the repeated bytes; n_chars follows. Characters that a span only touches stay whole.

    With ``least_words``, a run of repeated bytes goes only if it touches so many words (between spaces and tab to return).
    Rows without a repeat stay as they are, null texts too. The other columns stay, whatever their names.
    """
    _, spans = repeated_spans(docs, id_column=id_column, length=length, gram=gram)

    @F.arrow_udf("string")
    def cut(text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for raw, value, a, b in zip(text.cast(pa.binary()), text.to_pylist(), starts.to_pylist(), ends.to_pylist()):
            if value is None or not a:
                out.append(value)
                continue
            raw, at, parts = raw.as_py(), 0, []
            for x, y in zip(a, b):
                if least_words and len(raw[x:y].split()) < least_words:
                    continue
                while x < y and raw[x] & 0xC0 == 0x80:
                    x += 1
                while y > x and y < len(raw) and raw[y] & 0xC0 == 0x80:
                    y -= 1
                parts.append(raw[at:x])
                at = y
            out.append(b"".join([*parts, raw[at:]]).decode())
        return pa.array(out, pa.string())

    taken = {c.lower() for c in docs.columns}
    doc, tag, starts, ends = (next(n for n in (f"_{x}{k or ''}" for k in range(len(taken) + 1)) if n not in taken) for x in ("doc", "tag", "starts", "ends"))
    keyed = docs.withColumns({
        doc: F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63))), tag: F.xxhash64(F.coalesce(F.col("text"), F.lit(""))),
    })
    hit = keyed.join(spans.select("doc", "tag", "starts", "ends").toDF(doc, tag, starts, ends), [doc, tag], "left")
    none = F.array().cast("array<int>")
    text = F.when(F.col(starts).isNull(), F.col("text")).otherwise(cut(F.col("text"), F.coalesce(starts, none), F.coalesce(ends, none)))
    out = hit.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(starts).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)
