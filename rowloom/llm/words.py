"""Vectorised work on the UTF-8 bytes of a text column: slices, words, hashes.

Texts are read from Arrow buffers a few megabytes at a time, so a task's memory does
not depend on the batch size; a single longer text is a slice of its own. Null is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)


def char_class(*ranges: tuple[int, int], inverted: bool = False) -> np.ndarray:
    """Lookup table over bytes: True inside one of the closed ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return ~table if inverted else table


#: words of anything but space and the control characters tab to return
SPACED = char_class((0x20, 0x20), (0x09, 0x0D), inverted=True)
#: words of digits, lower-case letters and everything beyond ASCII (after lower-casing)
ALNUM = char_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F), inverted=True)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    return _LOWER[data]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the offset of each row's first byte (and the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(
    column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about ``most`` bytes."""
    data, offsets = buffers(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per row the index of its first word (and the end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | begins[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | begins[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all bits."""
    h = values.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal spans have equal hashes anywhere."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * powers(_BASE, n), out=sums[1:])
    shifted = (sums[ends] - sums[starts]) * powers(_BASE_INVERSE, n + 1)[starts]
    return mixed(shifted ^ mixed((ends - starts).astype(np.uint64)))


_SHINGLE_FACTORS = (
    np.random.default_rng(99).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
)


def shingles(hashes: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside a row, and the row of each.

    A row of fewer words, but not none, has its whole sequence as its only run.
    """
    counts = np.diff(firsts)
    total = len(hashes)
    if total == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    acc = np.zeros(total, np.uint64)
    for j in range(size):
        acc += padded[j : j + total] * _SHINGLE_FACTORS[j]
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(total) - firsts[:-1][row]
    full = place + size <= counts[row]
    out, rows = mixed(acc[full]), row[full]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k, r in enumerate(short):
            words = hashes[firsts[r] : firsts[r + 1]]
            extra[k] = (words * _SHINGLE_FACTORS[: len(words)]).sum(dtype=np.uint64) ^ np.uint64(len(words))
        out, rows = np.concatenate([out, mixed(extra)]), np.concatenate([rows, short])
    return out, rows


def distinct_by_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, sorted by row and value."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    if len(values):
        keep = np.ones(len(values), bool)
        keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        values, rows = values[keep], rows[keep]
    return values, rows
