"""op13 against a dynamic program over whole conversations in plain Python."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib

import pytest

from rowloom.llm import auction, conversations, q_conversations

SPACES = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def cheapest(codes: str) -> tuple[int, str]:
    """Least (cost, edits) by looking at every edit of every suffix; inserts never follow more than two at a place."""

    @functools.cache
    def best(i, q, inserts):
        found = [(0, "")] if i == len(codes) and q in (0, 3) else []
        need = 3 if q == 2 else 2
        if inserts < 3:
            cost, edits = best(i, need, inserts + 1)
            found.append((3 + cost, "I" + edits))
        if i < len(codes):
            turn = codes[i]
            cost, edits = best(i + 1, q, 0)
            found.append((4 + cost, "D" + edits))
            if turn != "x":
                extra, kind = 3 * turn.isupper(), turn.lower()
                keeps = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
                if (kind, q) in keeps:
                    cost, edits = best(i + 1, keeps[kind, q], 0)
                    found.append((extra + cost, "K" + edits))
                cost, edits = best(i + 1, need, 0)
                found.append((3 + extra + cost, "R" + edits))
        return min(found, default=(10**9, ""))

    for i in range(len(codes), -1, -1):  # keeps the recursion shallow
        for q in range(4):
            best(i, q, 0)
    return best(0, 0, 0)


def brute_report(rows):
    """By conversation: the contract's columns."""
    groups: dict = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role, text))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        seen, codes, counts, initials = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, _, role, text in turns:
            end = text.rstrip(SPACES)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
            seen.add((role, text))
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            initials.append(role[:1])
            if fault:
                counts[fault] += 1
            codes += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        cost, audit = cheapest(codes)
        lines, i, q = [], 0, 0
        for e in audit:
            need = 3 if q == 2 else 2
            name = "assistant" if need == 3 else "user"
            if e == "I":
                lines.append(f"{name}:")
                q = need
                continue
            _, _, role, text = turns[i]
            i += 1
            if e == "K":
                lines.append(f"{role}:{text}")
                q = {"s": 1, "u": 2, "a": 3}[role[:1]]
            elif e == "R":
                lines.append(f"{name}:{text}")
                q = need
        numbers = [t for known, t, _, _ in turns if known]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_codes(rng, n):
    return "".join(rng.choice("suaoxSUAOuauaua") for _ in range(n))


def test_auction_against_dynamic_program():
    rng = random.Random(1)
    for k in range(400):
        codes = random_codes(rng, k % 12 if k < 350 else 60)
        lattice = auction.Lattice(codes, auction.FINAL, True)
        cost = lattice.cost(0)
        end, edits = lattice.trace(0)
        assert (cost, edits) == cheapest(codes) and end in (0, 3)
        roles = "".join(x[-1] if x[-1] != "K" else c.lower() for x, c in zip(auction.actions(codes, 0, edits), codes) if x[-1] != "D")
        assert "K" not in roles


def test_runs_join_to_the_whole():
    rng = random.Random(2)
    for _ in range(60):
        parts = [random_codes(rng, rng.randint(1, 6)) for _ in range(rng.randint(1, 5))]
        mats = [auction.matrix(p, p is parts[-1]) for p in parts]
        after = [auction.FINAL]
        for m in reversed(mats[1:]):
            after.insert(0, auction.through(m, after[0]))
        state, edits, costs = 0, "", []
        for p, a in zip(parts, after):
            lattice = auction.Lattice(p, a, p is parts[-1])
            costs.append(lattice.cost(state))
            state, e = lattice.trace(state)
            edits += e
        assert (costs[0], edits) == cheapest("".join(parts))
        whole = functools.reduce(auction.product, mats)
        assert auction.through(whole, auction.FINAL)[0] == costs[0]


def made_up(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, 9) if conv != 7 else 230):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "usher", None])
            text = rng.choice(["Yes.", "No!", "So what?  \n", "open", " ", None, "", "é", f"t{rng.randint(0, 99)}.", "a\nb."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows + rows[:5]


COLUMNS = "conv_id long, turn long, role string, text string, c int, pos string"


def reported(df):
    return {r.c: tuple(r[x] for x in (*q_conversations.COUNTS, "audit", "repaired_sha256")) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "other") for r in rows], COLUMNS)


@pytest.mark.parametrize("run,fan", [(64, 512), (3, 2)])
def test_report(spark, monkeypatch, run, fan):
    monkeypatch.setattr(conversations, "RUN", run)
    monkeypatch.setattr(conversations, "FAN", fan)
    rows = made_up(run)
    want = brute_report([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    repair = conversations.Repair(conversations.turns_of(frame(spark, rows)))
    assert reported(repair.report()) == {"-" if c is None else f"={c}": v for c, v in want.items()}
    lines: dict = {}
    for r in repair.rows().orderBy("pos", "line").collect():
        lines.setdefault(r.c, []).append(f"{r.role}:{r.text}")
    for c, v in want.items():
        assert hashlib.sha256("\n".join(lines.get("-" if c is None else f"={c}", [])).encode()).hexdigest() == v[-1]


def test_damage(spark):
    rows = made_up(5)
    got = conversations.damaged(conversations.turns_of(frame(spark, rows))).select("conv_id", "turn", "role", "text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_damage(rows)))


def test_nothing(spark):
    assert conversations.Repair(conversations.turns_of(frame(spark, []))).report().collect() == []


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute_report(brute_damage(rows))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    got = {r.conv_id: tuple(r)[1:] for r in q_conversations.op13_conversation_repair(spark, sf).collect()}
    assert got == {r[0]: want.get(r[0], empty) for r in rows}
