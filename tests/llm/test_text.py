"""Operators on document texts against brute force: repeats, near-duplicates, decontamination, mixing."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rowloom.llm import decontaminate, minhash, mixing, q_repeats, repeats, words
from rowloom.llm.graph import components
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def prose(seed: int, n: int = 60) -> list[tuple]:
    """Texts that share passages, with copies, near copies, nulls, empty and repetitive ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(14)]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(30)) for _ in range(4)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.6:
            text += rng.choice(passages)[rng.randint(0, 10) :] + text[::-1]
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (n + 2, "a" * 300), (n + 3, "ab" * 150), (n + 4, " \t\n"), (n + 5, passages[0] + "x")]
    rows += [(n + 6, rows[5][1]), (n + 7, rows[7][1] + " b")]
    return rows


@pytest.mark.parametrize("length,gram,hot", [(24, 8, 20_000), (24, 8, 1), (40, 10, 20_000)])
def test_repeats(spark, length, gram, hot):
    rows = prose(1) + [(None, prose(1)[3][1]), (None, "é" * 50), prose(1)[9]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = Counter(tuple(r) for r in repeats.removed(df, length=length, gram=gram, hot=hot).collect())
    assert got == brute.removed(rows, length)


@pytest.mark.parametrize("length,short,gram,hot", [(40, 24, 8, 20_000), (40, 24, 8, 1), (90, 30, 10, 20_000)])
def test_repeats_with_shorter_passages(spark, length, short, gram, hot):
    # texts that end inside and right behind a repeated string, rows without an id, a repeated row
    rows = prose(6) + [(None, prose(6)[3][1]), (None, "é" * 50), prose(6)[9]]
    rows += [(3000 + i, f"{i} {i} " + prose(6)[65][1][: 20 + 7 * i]) for i in range(14)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = repeats.removed(df, length=length, gram=gram, hot=hot, short=short, least_words=9).collect()
    assert Counter(tuple(r)[:5] for r in found) == brute.removed(rows, length)
    want = Counter()
    for (key, text), flags in zip(rows, brute.long_runs(rows, short, 9)):
        runs = bytes(flags).split(b"\0")
        want[key, len((text or "").encode()), sum(map(bool, runs)), sum(flags)] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_passages, r.passage_bytes) for r in found) == want


def test_op1_counts_passages_below_its_length(spark, tmp_path):
    # 55 words in 330 bytes stay by the contract's 400 bytes, as do 50 words; both texts that hold the passage say so
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    tail = [" ".join(word() for _ in range(80)) for _ in range(5)]
    passage, fifty = (" ".join(word() for _ in range(n)) for n in (55, 50))
    rows = [(1, f"A {passage} {tail[0]}"), (2, f"B {passage} {tail[1]}"), (3, f"C {fifty[2:]} {tail[2]}"), (4, f"D {fifty[2:]} {tail[3]}"), (5, tail[4]), (6, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in q_repeats.op1_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert [got[i].n_removed for i in range(1, 7)] == [0] * 6
    assert [got[i].n_passages for i in range(1, 7)] == [1, 1, 0, 0, 0, 0]
    assert got[1].passage_bytes == len(passage) + 2


def test_repeats_of_nothing(spark):
    assert repeats.removed(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeats_in_a_long_text(spark):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    long = "".join(rng.choice("abcdefgh ") for _ in range(3_000_000))
    rows = [(1, long[:1_000_000] + passage + long[1_000_000:]), (2, "x" + passage + "y"), (3, "clean")]
    got = {r.doc_id: r for r in repeats.removed(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i].n_removed for i in (1, 2, 3)] == [900, 900, 0]
    assert [got[i].n_spans for i in (1, 2, 3)] == [1, 1, 0]


def test_removal_keeps_characters_and_columns(spark):
    text = "é" * 30 + "è" * 30
    rows = [(1, "s", "x" + text, 61, "kept"), (2, "s", "y" + text, 61, "kept"), (3, None, None, None, "kept"), (4, "t", "short", 5, "kept")]
    df = spark.createDataFrame(rows, "doc_id long, starts string, text string, n_chars long, tag string")
    out = {r.doc_id: r for r in repeats.remove(df, length=40, gram=8).collect()}
    assert out[1].text == "x" and out[2].text == "y" and out[1].n_chars == 1
    assert out[3].text is None and out[4].text == "short" and out[4].tag == "kept"


def test_near_duplicates(spark):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    rows = prose(4)
    for i in range(40):
        # similarities spread around the threshold, in a group larger than a chunk
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(120)] = f"x{rng.randint(0, 10**6)}"
        rows.append((1000 + i, " ".join(own)))
    rows += [(2000, "one two"), (2001, "ONE  two"), (2002, "one"), (2003, "one two three four five six")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", node long, cluster long")
    out = minhash.near_duplicates(df).collect()
    want = brute.components(rows)
    assert {r.doc_id: r.component_id for r in out} == want
    assert {r.doc_id: r.n_shingles for r in out} == {k: len(brute.shingles(t)) for k, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in out) and len(out) == len(rows)


def test_near_duplicates_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 5)
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(100)]
    rows = []
    for i in range(30):
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(100)] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(own)))
    out = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in out} == brute.components(rows)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_at_a_given_similarity(spark, percent):
    # one changed word in a row of n takes 5 of n - 4 shingles: similarities from 0.74 to 0.90
    rows = []
    for n in range(38, 96, 2):
        own = [f"w{n}_{k}" for k in range(n)]
        rows += [(2 * n, " ".join(own)), (2 * n + 1, " ".join(own[: n // 2] + ["x"] + own[n // 2 + 1 :]))]
    out = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), percent=percent).collect()
    assert {r.doc_id: r.component_id for r in out} == brute.components(rows, percent)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, None), (8, ""), (None, "z"), (9, "A b  c d e f")]
    out = Counter(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == Counter({
        (5, 2, 5, True): 2, (None, 2, 5, False): 1, (9, 2, 5, False): 1, (7, 0, 7, True): 1, (8, 0, 8, True): 1, (None, 1, None, False): 1,
    })
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_estimates_follow_similarity():
    rng = np.random.default_rng(0)
    for similarity in (0.5, 0.85, 0.95):
        shared = int(2000 * similarity / (1 + similarity) * 1)
        common = rng.integers(0, 1 << 63, shared, dtype=np.uint64)
        sets = [np.sort(np.concatenate([common, rng.integers(0, 1 << 63, 1000 - shared, dtype=np.uint64)])) for _ in range(2)]
        true = shared / (2000 - shared)
        packed = minhash.packed(minhash.minima(np.concatenate(sets), np.array([0, 1000, 2000])))
        assert abs(minhash.estimates(packed[:1], packed[1:])[0, 0] - true) < minhash.margin(true)


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5), (None, 3), (3, None)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            p, q = find(a), find(b)
            up[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"), (2, "short item here"), (3, None), (4, ""), (10, "One, TWO three-four five six seven eight nine ten!"),
    (5, "école été naïve"), (5, "école été naïve"), (6, "a a a a a a a a a a a a"), (None, "no id words"),
]
TEXTS = [
    (1, "x one two three four five six seven eight nine ten y"), (2, "two three four five six seven eight nine ten eleven twelve"), (3, "a SHORT item, here short item"), (4, None), (5, ""),
    (6, "zz École été naïve; école été naïve"), (7, "École été"), (8, "a " * 30), (9, "one two three four five six seven eight nine x ten"), (10, "no id words"), (1, "clean"),
]


@pytest.mark.parametrize("shard", [300_000, 12])
def test_decontamination(spark, shard):
    docs = spark.createDataFrame([(*r, "x") for r in TEXTS], SCHEMA + ", items string")
    found = decontaminate.find(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), shard_words=shard)
    got = Counter((r.doc_id, r.text, r._found.n_words, r._found.n_hit, tuple(r._found["items"])) for r in found.collect())
    want: Counter = Counter()
    for key, text in TEXTS:
        n, inside, named = brute.hits(text, ITEMS)
        want[key, text, n, len(inside), tuple(sorted(str(i) for i in named if i is not None))] += 1
    assert got == want


def test_decontamination_removes_only_hits(spark):
    docs = spark.createDataFrame([(1, "Start. école été, NAïVE end of it all.", 38), (2, "short item here", 15), (3, None, None), (4, "clean  text", 11)], SCHEMA + ", n_chars long")
    out = {r.doc_id: r for r in decontaminate.remove(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert set(out) == {1, 3, 4}
    assert out[1].text == "Start.  end of it all." and out[1].n_chars == len(out[1].text) and out[4].text == "clean  text"
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.remove(docs, none).count() == 4
    with pytest.raises(ValueError):
        decontaminate.find(docs.withColumnRenamed("n_chars", "_found"), none)


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, " ".join("w" * rng.randint(0, 30)), rng.choice(["a", "b", "b", "b", "b", "é", "c", None])) for i in range(400)]
    rows += [(900, None, "empty"), (901, "", "empty"), (902, "x\ty z", "a"), (902, "x\ty z", "a")]
    df = spark.createDataFrame([(*r, 5) for r in rows], SCHEMA + ", source string, size long")
    out = mixing.mix(df).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(brute.SPACED.findall(text or ""))
    want = brute.targets(dict(sizes))
    taken = Counter()
    for r in out:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    assert len(out) == len(rows) and {s: taken[s] for s in sizes} == {s: round(want[s]) for s in sizes}
    assert Counter(map(tuple, out)) == Counter(map(tuple, mixing.mix(df.repartition(3)).collect()))


def test_mixing_over_many_ranges(spark, monkeypatch):
    rows = [(i, "w " * (i % 7), "hot" if i % 3 else "b") for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA + ", source string")
    whole = Counter(map(tuple, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    monkeypatch.setattr(mixing, "GROUP_RANGES", 4)
    assert Counter(map(tuple, mixing.mix(df).collect())) == whole
    assert mixing.mix(df.where("false")).collect() == []


def test_word_spans_and_hashes():
    texts = ["", None, "a bb  a", "\ta\n", "bb", "é a"]
    (part,) = words.slices(pa.array(texts))
    first, last, data, offsets = part
    starts, ends, firsts = words.spans(data, offsets, words.SPACED)
    found = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert found == ["a", "bb", "a", "a", "bb", "é", "a"] and np.diff(firsts).tolist() == [0, 0, 3, 1, 1, 2]
    hashes = words.span_hashes(data, starts, ends)
    assert len({(w, h) for w, h in zip(found, hashes.tolist())}) == len(set(found)) == len(set(hashes.tolist()))
