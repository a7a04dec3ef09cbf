"""Find and remove benchmark passages with a generalised suffix automaton over words.

The normalised words of all test items form one automaton. A document's words stream
through it; the state always stands for the longest suffix read so far that occurs in some
item, so the longest matching length is known at each word. Windows are marked on the states
that stand for them: a window occurs where the current state or one of its suffixes is marked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm import words
from rowloom.llm.common import text_batches
from rowloom.session import settle

WINDOW = 10
#: words of one automaton; further items go to further automata, one pass over the documents each
SHARD_WORDS = 300_000


class Automaton:
    """Suffix automaton of several word sequences, with the windows that end at each state."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.codes: dict[int, int] = {}
        self.sequences: list[tuple[str | None, list[int]]] = []
        self.n_words = 0

    def add(self, item: str | None, hashes: np.ndarray) -> None:
        codes = [self.codes.setdefault(int(h), len(self.codes)) for h in hashes]
        self.sequences.append((item, codes))
        self.n_words += len(codes)
        last = 0
        for c in codes:
            last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        following = self.next[last].get(c)
        if following is not None and self.length[following] == self.length[last] + 1:
            return following
        if following is not None:
            return self._split(last, c, following)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for the strings of ``q`` that ``p`` and its suffixes reach."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def finish(self) -> Automaton:
        """Mark the windows; build the tables that let whole stretches of words be passed over."""
        self.marks: dict[int, dict[int, set[str]]] = {}
        for item, codes in self.sequences:
            size = min(self.window, len(codes))
            if not size:
                continue
            state, matched = 0, 0
            for c in codes:
                state, matched = self.step(state, matched, c)
                if matched >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    self.marks.setdefault(at, {}).setdefault(size, set()).update(() if item is None else (item,))
        # the nearest marked state among a state and its suffixes
        self.marked = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.marked[s] = s if s in self.marks else self.marked[self.link[s]]
        self.shortest = min((m for by in self.marks.values() for m in by), default=0)
        known = np.array(list(self.codes), np.uint64)
        order = np.argsort(known)
        self.known, self.code_of = known[order], order.astype(np.int64)
        pairs = [a * len(known) + b for _, codes in self.sequences for a, b in zip(codes, codes[1:])]
        self.pairs = np.unique(np.array(pairs, np.int64))
        self.sequences, self.codes = [], {}
        return self

    def step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        while state and c not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        following = self.next[state].get(c)
        return (0, 0) if following is None else (following, matched + 1)

    def stretches(self, hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all words (-1: in no item), and starts and ends of runs of words that may hold a window.

        In a run each pair of neighbours is a pair of neighbours in some item; anything that matches lies within one.
        """
        codes = np.full(len(hashes), -1, np.int64)
        nothing = np.zeros(0, np.int64)
        if not len(self.known) or not len(hashes) or not self.shortest:
            return codes, nothing, nothing
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        hit = self.known[at] == hashes
        codes[hit] = self.code_of[at[hit]]
        joined = np.zeros(len(hashes) + 1, bool)
        both = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0)) + 1
        if len(self.pairs) and len(both):
            keys = codes[both - 1] * len(self.known) + codes[both]
            k = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            joined[both] = self.pairs[k] == keys
        joined[firsts] = False
        starts = np.flatnonzero((codes >= 0) & ~joined[:-1])
        ends = np.flatnonzero((codes >= 0) & ~joined[1:]) + 1
        long = ends - starts >= self.shortest
        return codes, starts[long], ends[long]

    def matches(self, codes: list[int]) -> Iterator[tuple[int, int, int, set[str]]]:
        """(start, end, longest matching length at the end, items) of each window that occurs."""
        state = matched = 0
        for i, c in enumerate(codes):
            state, matched = self.step(state, matched, c)
            at = self.marked[state]
            while at > 0:
                for size, items in self.marks[at].items():
                    if size <= matched:
                        yield i + 1 - size, i + 1, matched, items
                at = self.marked[self.link[at]]


def _normalised(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for first, last, data, offsets in words.slices(column):
        data = words.lower_ascii(data)
        starts, ends, firsts = words.spans(data, offsets, words.ALNUM)
        yield first, last, starts, ends, firsts, words.span_hashes(data, starts, ends)


def automata(benchmark: DataFrame, *, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> Iterator[Automaton]:
    """Automata of the items, one at a time, each of about ``shard_words`` words at most.

    Items come through the driver in id order, a bounded number at once. A longer item is cut into pieces that
    overlap by a window less a word, so no window is lost; a match's longest length then ends with its piece.
    """
    current = Automaton(window)
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), "text").where(F.col("text").isNotNull())
    for row in rows.orderBy("i", "text").toLocalIterator():
        for _, _, _, _, _, hashes in _normalised(pa.array([row.text])):
            most = max(shard_words, window)
            for at in range(0, max(len(hashes) - window + 1, 1), most - window + 1):
                piece = hashes[at : at + most]
                if current.n_words and current.n_words + len(piece) > shard_words:
                    yield current.finish()
                    current = Automaton(window)
                current.add(row.i, piece)
    yield current.finish()


FOUND = "struct<n_words:bigint,n_hit:bigint,longest:bigint,starts:array<bigint>,ends:array<bigint>,items:array<string>>"


def _found_column(text: Column, before: Column | None, automaton) -> Column:
    """FOUND of a text: hit words, and byte spans from the first to the last word of each run of hits."""

    def find(column: pa.Array, earlier: pa.Array | None) -> pa.Array:
        model = automaton.value
        old = earlier.to_pylist() if earlier is not None else None
        out = []
        for first, last, starts, ends, firsts, hashes in _normalised(column):
            offsets = words.buffers(column.slice(first, last - first))[1]
            codes, run_starts, run_ends = model.stretches(hashes, firsts)
            run_rows = np.searchsorted(firsts, run_starts, side="right") - 1
            spans: dict[int, list[tuple[int, int]]] = {}
            longest: dict[int, int] = {}
            items: dict[int, set[str]] = {}
            for row, a, b in zip(run_rows.tolist(), run_starts.tolist(), run_ends.tolist()):
                for x, y, length, which in model.matches(codes[a:b].tolist()):
                    spans.setdefault(row, []).append((a + x, a + y))
                    longest[row] = max(longest.get(row, 0), length)
                    items.setdefault(row, set()).update(which)
            for row in range(last - first):
                base, n = int(offsets[row]), int(firsts[row + 1] - firsts[row])
                seen = old[first + row] if old else None
                mine = spans.get(row, [])
                if not mine and not seen:
                    out.append((n, 0, 0, [], [], []))
                    continue
                hit = np.zeros(n + 1, np.int64)
                for x, y in mine:
                    hit[x - firsts[row]] += 1
                    hit[y - firsts[row]] -= 1
                flags = np.cumsum(hit)[:n] > 0
                own_starts, own_ends = starts[firsts[row] : firsts[row + 1]] - base, ends[firsts[row] : firsts[row + 1]] - base
                top, named = longest.get(row, 0), items.get(row, set())
                if seen:
                    for s, e in zip(seen["starts"], seen["ends"]):
                        flags[np.searchsorted(own_starts, s) : np.searchsorted(own_starts, e)] = True
                    top, named = max(top, seen["longest"]), named | set(seen["items"])
                edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
                out.append((
                    n, int(flags.sum()), top, own_starts[np.flatnonzero(edge == 1)].tolist(),
                    own_ends[np.flatnonzero(edge == -1) - 1].tolist(), sorted(named),
                ))
        names = ["n_words", "n_hit", "longest", "starts", "ends", "items"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(6)], names)

    if before is None:

        @F.arrow_udf(FOUND)
        def first_pass(column: pa.Array) -> pa.Array:
            return find(column, None)

        return first_pass(text)

    @F.arrow_udf(FOUND)
    def next_pass(column: pa.Array, earlier: pa.Array) -> pa.Array:
        return find(column, earlier)

    return next_pass(text, before)


def find(docs: DataFrame, benchmark: DataFrame, *, found: str = "_found", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with a struct column ``found``: what of each text lies inside a window of a test item.

    A window is ``window`` consecutive words of an item; an item of fewer, but not none, is one window.
    starts and ends are byte offsets into the UTF-8 text, longest is the longest matching length in words.
    Null and empty texts have no words. Items without words hit nothing, items without an id hit but are not
    listed. Repeated rows of either table and tables without rows need no care. Raises if ``found`` is a column of ``docs``.
    """
    spark = docs.sparkSession
    if found in docs.columns:
        raise ValueError(f"documents already have a column {found}")
    text_batches(spark)
    out = None
    for automaton in automata(benchmark, window=window, shard_words=shard_words):
        if out is not None:
            out = settle(out, "decontaminate")
        shared = spark.sparkContext.broadcast(automaton)
        before = None if out is None else F.col(found)
        out = (docs if out is None else out).withColumn(found, _found_column(F.col("text"), before, shared))
    return out


def without_spans(text: Column, starts: Column, ends: Column) -> Column:
    """``text`` without the given byte spans, which are sorted and do not overlap."""

    @F.arrow_udf("string")
    def cut(column: pa.Array, first: pa.Array, after: pa.Array) -> pa.Array:
        out = []
        for value, a, b in zip(column.to_pylist(), first.to_pylist(), after.to_pylist()):
            if value is None or not a:
                out.append(value)
                continue
            raw, at, parts = value.encode(), 0, []
            for x, y in zip(a, b):
                parts.append(raw[at:x])
                at = y
            out.append(b"".join([*parts, raw[at:]]).decode())
        return pa.array(out, pa.string())

    return cut(text, starts, ends)


def remove(docs: DataFrame, benchmark: DataFrame, *, most_coverage: float = 0.5, window: int = WINDOW) -> DataFrame:
    """``docs`` without the words inside windows; a document of which more than ``most_coverage`` is hit goes whole.

    n_chars follows the new text. Documents without a hit stay byte for byte, null texts too; other columns stay, whatever their names.
    """
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in (f"_found{k or ''}" for k in range(len(taken) + 1)) if n not in taken)
    marked, found = find(docs, benchmark, found=name, window=window), F.col(name)
    kept = marked.where(found["n_hit"] <= most_coverage * found["n_words"])
    text = F.when(found["n_hit"] == 0, F.col("text")).otherwise(without_spans(F.col("text"), found["starts"], found["ends"]))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(found["n_hit"] == 0, F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return kept.withColumns(new).select(*docs.columns)
