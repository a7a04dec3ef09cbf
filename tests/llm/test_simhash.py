"""op11: the code's tables, the keys' promise, and components against comparing all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from rowloom.llm import golay, q_simhash, simhash
from tests.llm import brute


def brute_print(text: str | None, size: int = 4) -> int:
    words = brute.SPACED.findall((text or "").translate(brute.LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(max(len(words) - size, 0) + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows: list[tuple]) -> list[tuple]:
    prints = [brute_print(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                up[find(i)] = find(j)
    least: dict = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [(key, f"{p:016x}", least.get(find(i))) for i, ((key, _), p) in enumerate(zip(rows, prints))]


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_code_is_perfect():
    errors, counts = golay.tables()
    weights = np.bitwise_count(errors[:, 0])
    assert np.bincount(weights).tolist() == [1, 23, 253, 1771]
    assert (counts == np.where(weights == 3, 6, 1)).all()
    assert (golay.syndromes(errors) == np.arange(2048)[:, None]).all()
    assert (np.bitwise_count(errors[weights == 3, 1:]) == 4).all()


def test_words_two_bits_apart_share_a_key():
    rng = np.random.default_rng(1)
    for word in rng.integers(0, 1 << 23, 60):
        flips = [0, *(1 << i for i in range(23)), *((1 << i) | (1 << j) for i in range(23) for j in range(i))]
        codes, counts = golay.keys(np.array([word ^ f for f in flips]))
        own = set(codes[0][: counts[0]].tolist())
        for k, f in enumerate(flips):
            theirs = set(codes[k][: counts[k]].tolist())
            assert own & theirs
            if f.bit_count() <= 1:
                assert codes[0][0] in theirs and codes[k][0] in own


def test_prints_four_bits_apart_meet():
    rng = random.Random(2)
    pairs = []
    for _ in range(4_000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        pairs += [x, y]
    row, keys = simhash.meeting_keys(np.array(pairs, np.uint64))
    by_row = [set() for _ in pairs]
    for r, k in zip(row.tolist(), keys.tolist()):
        assert k not in by_row[r]
        by_row[r].add(k)
    assert all(by_row[i] & by_row[i + 1] for i in range(0, len(pairs), 2))


def test_fingerprints_of_odd_texts(monkeypatch):
    monkeypatch.setattr(simhash, "PART", 7)
    rng = random.Random(3)
    texts = [None, "", " \t\n", "One", "a B  c", "É é\x0b x y z", "w " * 50, "\x00 \x7f a b c d"]
    texts += [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in range(40)]
    got = np.concatenate(list(simhash.fingerprints(pa.array(texts))))
    assert got.tolist() == [brute_print(t) for t in texts]


def test_components_of_made_up_rows(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 300))]
        rows.append((i, " ".join(words)))
        for k in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "other"
            rows.append((100 + 10 * i + k, " ".join(words)))
    rows += [(900, None), (901, ""), (902, " "), (3, rows[0][1]), (None, rows[5][1]), (None, "alone"), (903, "alone two"), rows[7], rows[7]]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, component_id string")
    assert order(simhash.fuzzy_duplicates(frame).collect()) == order(brute_components(rows))


def test_chunks_give_the_same_links(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(300):
        x = rng.choice(sorted(prints))
        for b in rng.sample(range(64), rng.randint(1, 3)):
            x ^= 1 << b
        prints.add(x)
    signed = [(int(np.array(x, np.uint64).view(np.int64)),) for x in prints]
    for chunk in (1_000, 7):
        pairs = simhash.links(spark.createDataFrame(signed, "node long"), chunk=chunk).collect()
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in pairs)
        up = {x: x for (x,) in signed}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[find(a)] = find(b)
        assert len({find(x) for x in up}) == 1


def test_nothing(spark):
    assert simhash.fuzzy_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        simhash.fuzzy_duplicates(spark.createDataFrame([], "doc_id long, text string"), most=5)


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert order(q_simhash.op11_simhash_golay(spark, sf).collect()) == order(brute_components(rows))
