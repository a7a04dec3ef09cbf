"""op12 against counting every gram in plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from rowloom.llm import collocations as module
from rowloom.llm.collocations import collocations
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, n int, phrase string"


def brute_phrases(rows, least, share=80, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    cands = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    inside: dict = {}
    for (lang, g), v in cands.items():
        for m in range(2, len(g)):
            for i in range(len(g) - m + 1):
                inside[lang, g[i : i + m]] = max(v, inside.get((lang, g[i : i + m]), 0))
    out: dict = {}
    for (lang, g), a in cands.items():
        if 100 * inside.get((lang, g), 0) >= share * a:
            continue
        cuts = [(2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -s)
        for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])
    )


def made_up(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "é", "Éa", "x1", "\x00q", "ab", "-"]
    line = "of New  york\tthe"
    rows = []
    for i in range(150):
        text = "".join(
            rng.choice([*vocabulary, line, line]) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "; "]) for _ in range(rng.randint(0, 60))
        )
        rows.append((i, text, rng.choice(["en", "en", "fr", None, "und", ""])))
    return rows + [(1, None, "en"), (2, "", None), (3, " .\n", "de"), (None, rows[3][1], rows[3][2]), rows[5], rows[5], (9, "a b " * 200, "xx")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "other") for r in rows], SCHEMA)


@pytest.mark.parametrize("least,share,top", [(30, 80, 2000), (3, 60, 7), (1, 100, 2000)])
def test_phrases(spark, least, share, top):
    rows = made_up(least)
    got = collocations(frame(spark, rows), least=least, share=share, top=top)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, least, share, top)


def test_dealt_nodes(spark, monkeypatch):
    """Hot first nodes that are dealt to many tasks, sums over small arrays."""
    for name, value in (("HOT", 50), ("SUM_ROWS", 64)):
        monkeypatch.setattr(module, name, value)
    rows = made_up(8)
    df = frame(spark, rows)
    texts = df.selectExpr("coalesce(lang, 'und') as lang", "text")
    every = spark.sparkContext.broadcast(np.full(1 << 14, ~np.uint64(0)))
    assert len(module.hot_nodes(texts, every)) > 3
    assert sorted(map(tuple, collocations(df, least=5).collect())) == brute_phrases(rows, 5)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    rows = made_up(9)
    batch = pa.RecordBatch.from_arrays([pa.array([r[2] or "und" for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])

    def counts():
        found = Counter()
        for part in module._longest(SimpleNamespace(value=None))(iter([batch])):
            for a, b, c, n, _ in zip(*(column.to_pylist() for column in part.columns)):
                found[a, b, c] += n
        return found

    whole = counts()
    monkeypatch.setattr(module, "SLICE_BYTES", 60)
    monkeypatch.setattr(module, "HELD_ROWS", 200)
    assert len(list(module.gram_slices(batch))) > len(rows) and counts() == whole


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """Filters of 64 bits let nearly everything pass; the rows are the same."""
    monkeypatch.setattr(module, "FILTER_BITS", (6, 6))
    rows = made_up(10)
    assert sorted(map(tuple, collocations(frame(spark, rows), least=12).collect())) == brute_phrases(rows, 12)


def test_nothing(spark):
    assert collocations(frame(spark, [])).collect() == []
    assert collocations(frame(spark, [(1, "a b", "en")])).collect() == []
