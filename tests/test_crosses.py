"""Means of crosses on packed codes, against joined texts and a dictionary of sums."""

import random

import pytest

from rowloom.operators import categories as cat
from rowloom.operators import crosses
from rowloom.operators.crosses import CrossMeans

COLS = ["a", "b", "x", "n"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for i in range(700):
        split = "test" if i % 4 == 0 else "train"
        a = rng.choice(["p", "q", "q_", "", None]) if split == "train" else rng.choice(["p", "q", None, "new"])
        b = rng.choice(["u", "_u", "w"])
        x = rng.choice([0.5, -2.0, 1e300, None, *([rng.random()] * 2)])
        out.append((i, split, i % 5 if split == "train" else None, rng.randint(0, 1) if split == "train" else None, a, b, x, rng.randint(0, 3)))
    # a level that only one fold has
    return out + [(1000, "train", 2, 1, "rare", "u", 7.0, 9), (1001, "train", 2, 0, "rare", "u", 7.0, 9), (1002, "test", None, None, "rare", "u", 7.0, 9)]


def expected(rows, k=5):
    """From sums per cross and fold."""
    out = {r[0]: [] for r in rows}
    cells = {"a": 4, "b": 5, "x": 6, "n": 7}
    for left, right, _ in cat.cross_columns(COLS):
        key = lambda r: (r[cells[left]], r[cells[right]]) if None not in (r[cells[left]], r[cells[right]]) else None  # noqa: E731, B023
        sums: dict = {}
        for r in rows:
            if r[1] == "train" and key(r) is not None:
                for part in (r[2], None):
                    s, n = sums.get((key(r), part), (0, 0))
                    sums[key(r), part] = s + r[3], n + 1
        levels = {c for c, part in sums if part is None}

        def rest(level, f):
            s, n = sums[level, None]
            own, m = sums.get((level, f), (0, 0))
            return (s - own) / (n - m) if n > m else None

        fills = []
        for f in range(k):
            known = [v for v in (rest(level, f) for level in levels) if v is not None]
            fills.append(sum(known) / len(known))
        for r in rows:
            level = key(r)
            if r[1] == "train":
                out[r[0]].append(rest(level, r[2]) if level in levels else None)
            else:
                parts = [rest(level, f) if level in levels else None for f in range(k)]
                out[r[0]].append(sum(fills[f] if v is None else v for f, v in enumerate(parts)) / k)
    return out


@pytest.mark.parametrize("bytes_,batch", [(None, 8), (0, 8), (0, 2), (15_000, 1)])
def test_means_of_crosses(spark, rows, monkeypatch, bytes_, batch):
    monkeypatch.setattr(crosses, "BATCH_PAIRS", batch)
    df = spark.createDataFrame(rows, "id long, split string, fold int, target int, a string, b string, x double, n int")
    got = CrossMeans.fit(df, COLS).transform(bytes_=bytes_)
    assert got.columns == ["id", *[f"{n}_te" for *_, n in cat.cross_columns(COLS)]]
    want = expected(rows)
    found = {r[0]: list(r)[1:] for r in got.collect()}
    assert found.keys() == want.keys()
    for i, values in want.items():
        assert found[i] == [None if v is None else pytest.approx(v, abs=1e-12) for v in values]


def test_equal_to_joined_texts(spark, rows):
    """Where no text holds the joining character both ways agree."""
    plain = [r for r in rows if "_" not in (r[4] or "") + r[5]]
    df = spark.createDataFrame(plain, "id long, split string, fold int, target int, a string, b string, x double, n int")
    names = [n for *_, n in cat.cross_columns(COLS)]
    joined = cat.cross_categories(df, COLS, ["id", "split", "fold", "target"])
    old = cat.TargetEncoder.fit(joined, names).transform(joined).select("id", *[f"{n}_te" for n in names])
    new = CrossMeans.fit(df, COLS).transform()
    a, b = ({r[0]: list(r)[1:] for r in x.collect()} for x in (old, new))
    assert all(a[i] == [None if v is None else pytest.approx(v, abs=1e-12) for v in b[i]] for i in a)


def test_plan_has_few_joins(spark, rows):
    df = spark.createDataFrame(rows, "id long, split string, fold int, target int, a string, b string, x double, n int")
    plan = CrossMeans.fit(df, COLS).transform()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 0
