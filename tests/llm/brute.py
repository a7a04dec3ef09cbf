"""Plain single-machine versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def repeated(rows: list[tuple], length: int) -> list[bytearray]:
    """Per (id, text) row a flag per byte: covered by a string of ``length`` bytes that starts twice."""
    raw = [(text or "").encode() for _, text in rows]
    seen: Counter = Counter()
    for b in raw:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        flags = bytearray(len(b))
        end = 0
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                for j in range(max(i, end), i + length):
                    flags[j] = 1
                end = i + length
        out.append(flags)
    return out


def long_runs(rows: list[tuple], length: int, least_words: int) -> list[bytearray]:
    """Flags as above, without the runs that touch fewer than ``least_words`` words."""
    out = repeated(rows, length)
    for (_, text), flags in zip(rows, out):
        raw = (text or "").encode()
        for run in re.finditer(b"\x01+", bytes(flags)):
            if len(raw[run.start() : run.end()].split()) < least_words:
                flags[run.start() : run.end()] = bytes(run.end() - run.start())
    return out


def removed(rows: list[tuple], length: int) -> Counter:
    out: Counter = Counter()
    for (key, text), flags in zip(rows, repeated(rows, length)):
        b = (text or "").encode()
        kept = bytes(x for x, f in zip(b, flags) if not f)
        spans = sum(1 for j in range(len(b)) if flags[j] and (j == 0 or not flags[j - 1]))
        out[key, len(b), sum(flags), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def shingles(text: str | None, size: int = 5) -> frozenset:
    words = SPACED.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(len(words) - size, 0) + 1))


def components(rows: list[tuple], percent: int = 85) -> dict:
    """Component of each id, ids being distinct."""
    sets = {key: shingles(text) for key, text in rows}
    up = {key: key for key in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {key: find(key) for key in sets}


def hits(text: str | None, items: list[tuple], window: int = 10) -> tuple[int, set, set]:
    """(words, positions inside an occurring window, item ids) of a document."""
    words = ALNUM.findall((text or "").translate(LOWER))
    inside, named = set(), set()
    for item, item_text in items:
        own = ALNUM.findall((item_text or "").translate(LOWER))
        m = min(window, len(own))
        if not m:
            continue
        windows = {tuple(own[i : i + m]) for i in range(len(own) - m + 1)}
        for i in range(len(words) - m + 1):
            if tuple(words[i : i + m]) in windows:
                inside.update(range(i, i + m))
                named.add(item)
    return len(words), inside, named


def targets(sizes: dict, weights=(5, 2, 1), most: int = 3) -> dict:
    """Water filling by repeated sharing."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out = {s: 0.0 for s in sizes}
    left, open_ = float(sum(sizes.values())), set(sizes)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        full = {s for s in open_ if out[s] + share[s] >= most * sizes[s]}
        if not full:
            for s in open_:
                out[s] += share[s]
            break
        for s in full:
            left -= most * sizes[s] - out[s]
            out[s] = float(most * sizes[s])
        open_ -= full
    return out
