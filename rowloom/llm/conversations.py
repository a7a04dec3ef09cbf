"""Faults of conversations, and their cheapest repair by auctions over short runs of turns.

All turns are put in one order by ranges of (conversation, turn) and numbered, so no conversation has to
fit a task. Every RUN numbers make a run. Runs of one conversation are tied together by the costs from each
state before a run to each state behind it: a scan from the end gives the cost that is still to come behind
each run, the run's own auction then gives its edits for each state it may begin with, and a scan from the
start picks the one. Scans go through blocks of FAN runs, blocks of blocks, and so on, one task a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm import auction
from rowloom.llm.common import text_batches
from rowloom.session import settle

RUN = 64
FAN = 512
BLANKS = " \t\n\x0b\x0c\r"


def conversation_key(column: str | Column) -> Column:
    """A text that is never null and tells all ids apart."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


def turns_of(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, c, turn, role, text); a null role or text is one space, ``c`` tells conversations apart."""
    return table.select(
        F.col(conv).alias("conv_id"), conversation_key(conv).alias("c"), F.col(turn).alias("turn"),
        *(F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(y) for x, y in ((role, "role"), (text, "text"))),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with the faults that crc32 of ``conv_id:turn`` modulo 20 names: drop, empty, strip, repeat, rerole."""
    spoken = F.concat(*(F.coalesce(F.col(x).cast("string"), F.lit(" ")) if x else F.lit(":") for x in ("conv_id", "", "turn")))
    hit = turns.withColumn("_hit", F.crc32(F.encode(spoken, "utf-8")) % 20).where("_hit != 0")
    text = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_hit") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hit.select("conv_id", "c", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def numbered(turns: DataFrame) -> DataFrame:
    """``turns`` with ``pos``, their number in the order of conversation, turn (null first), role and text, from 0.

    Equal rows are spread too: a number of their own ends the order.
    """
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_tie")]
    spread = turns.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    kept = settle(spread.withColumn("_at", F.monotonically_increasing_id()), "turns")
    part = F.shiftright("_at", 33)
    # one row a partition
    sizes = kept.groupBy(part.alias("_part")).count().orderBy("_part").collect()
    before, rows = 0, []
    for r in sizes:
        rows.append((r["_part"], before))
        before += r["count"]
    starts = turns.sparkSession.createDataFrame(rows, "_part bigint, _start bigint")
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("pos", F.col("_start") + inside).drop("_part", "_start", "_at")


def faulted(turns: DataFrame) -> DataFrame:
    """Numbered turns with ``fault``: blank, duplicate (role and text seen earlier), truncated or null, the first that holds."""
    digest = F.md5(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), "utf-8"))
    keyed = turns.withColumn("digest", digest)
    firsts = keyed.groupBy("c", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = settle(firsts.select("c", "digest", "first"), "firsts")
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (
        F.when(end == "", "blank").when(F.col("first") < F.col("pos"), "duplicate")
        .when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    return keyed.join(firsts.hint("merge"), ["c", "digest"], "left").withColumn("fault", fault).drop("digest", "first")


def runs_of(turns: DataFrame) -> DataFrame:
    """(c, run, start, codes, roles, last): runs of at most RUN turns as letters; ``roles`` has the letters of all turns."""
    initial = F.left(F.col("role"), F.lit(1))
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    letters = turns.select("c", "pos", F.floor(F.col("pos") / RUN).alias("run"), code.alias("code"), kind.alias("kind"))
    grouped = letters.groupBy("c", "run").agg(F.min("pos").alias("start"), F.array_sort(F.collect_list(F.struct("pos", "code", "kind"))).alias("t"))
    ends = letters.groupBy("c").agg(F.min("run").alias("lowest"), F.max("run").alias("highest"))
    return grouped.join(ends, "c").select(
        "c", "run", "start", F.array_join("t.code", "").alias("codes"), F.array_join("t.kind", "").alias("roles"),
        (F.col("run") == F.col("lowest")).alias("first"), (F.col("run") == F.col("highest")).alias("last"),
    )


def _rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema, each: Callable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pylist([each(r) for r in batch.to_pylist()], schema)


def _stepper(step: Callable, schema: pa.Schema):
    """States before each element of a block; blocks arrive in order, and begin with the state of their first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, state = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["c"], r["g"]) != block:
                    block, state = (r["c"], r["g"]), r["s"]
                out.append({"c": r["c"], "k": r["k"], "s": state})
                state = step(state, r["x"])
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _folder(join: Callable, schema: pa.Schema):
    """One element for each block, the composition of its elements in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, value = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["c"], r["g"]) != block:
                    if block is not None:
                        out.append({"c": block[0], "k": block[1], "x": value})
                    block, value = (r["c"], r["g"]), r["x"]
                else:
                    value = join(value, r["x"])
            yield pa.RecordBatch.from_pylist(out, schema)
        if block is not None:
            yield pa.RecordBatch.from_pylist([{"c": block[0], "k": block[1], "x": value}], schema)

    return run


_INTS = pa.list_(pa.int32())
_KEYED = [("c", pa.string()), ("k", pa.int64())]


def scanned(elements: DataFrame, step: Callable, join: Callable, start: list[int], backward: bool, fan: int | None = None) -> DataFrame:
    """(c, k, s): the state before each element (c, k, x) of its conversation, from ``start`` on, in the order of k or against it."""
    fan = fan or FAN
    elements = elements.withColumn("g", F.floor(F.col("k") / fan))
    spread = elements.groupBy("c").agg((F.max("g") - F.min("g")).alias("more")).agg(F.max("more")).first()[0] or 0
    order = F.col("k").desc() if backward else F.col("k")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition("c", "g").sortWithinPartitions("c", "g", order)

    if spread == 0:
        begun = elements.withColumn("s", F.array(*(F.lit(x) for x in start)))
    else:
        blocks = dealt(elements).mapInArrow(_folder(join, pa.schema([*_KEYED, ("x", _INTS)])), "c string, k bigint, x array<int>")
        above = scanned(settle(blocks, "blocks"), step, join, start, backward, fan)
        begun = elements.join(above.select("c", F.col("k").alias("g"), "s"), ["c", "g"])
    return settle(dealt(begun).mapInArrow(_stepper(step, pa.schema([*_KEYED, ("s", _INTS)])), "c string, k bigint, s array<int>"), "scan")


def _step_costs(after: list[int], m: list[int]) -> list[int]:
    return auction.through(m, after)


def _join_costs(behind: list[int], before: list[int]) -> list[int]:
    return auction.product(before, behind)


def _step_state(state: list[int], exits: list[int]) -> list[int]:
    return [exits[state[0]]]


def _join_exits(first: list[int], then: list[int]) -> list[int]:
    return [auction.NONE if q == auction.NONE else then[q] for q in first]


_WAY = pa.struct([("cost", pa.int64()), ("exit", pa.int32()), ("edits", pa.string()), ("actions", pa.list_(pa.string()))])


def _costs(r: dict) -> dict:
    return {"c": r["c"], "k": r["run"], "x": auction.matrix(r["codes"], r["last"])}


def _ways(r: dict) -> dict:
    lattice, ways = auction.Lattice(r["codes"], r["s"], r["last"]), []
    for q in range(1 if r["first"] else auction.STATES):
        cost = lattice.cost(q)
        end, edits = (auction.NONE, "") if cost == auction.NONE else lattice.trace(q)
        ways.append({"cost": cost, "exit": end, "edits": edits, "actions": [] if cost == auction.NONE else auction.actions(r["codes"], q, edits)})
    ways += ways[:1] * (auction.STATES - len(ways))
    return {"c": r["c"], "k": r["run"], "ways": ways}


def planned(runs: DataFrame) -> DataFrame:
    """Runs with the cheapest way through each: ``way`` (cost to the end of the conversation, exit, edits, actions)."""
    runs = settle(runs, "runs")
    many = runs.where("not (first and last)")
    costs = many.mapInArrow(lambda b: _rows(b, pa.schema([*_KEYED, ("x", _INTS)]), _costs), "c string, k bigint, x array<int>")
    after = scanned(settle(costs, "costs"), _step_costs, _join_costs, auction.FINAL, True)
    told = runs.join(after.select("c", F.col("k").alias("run"), "s"), ["c", "run"], "left")
    told = told.withColumn("s", F.coalesce("s", F.array(*(F.lit(x) for x in auction.FINAL))))
    ways = told.select("c", "run", "codes", "first", "last", "s").mapInArrow(
        lambda b: _rows(b, pa.schema([*_KEYED, ("ways", pa.list_(_WAY))]), _ways),
        "c string, k bigint, ways array<struct<cost:bigint,exit:int,edits:string,actions:array<string>>>",
    )
    ways = settle(ways, "ways")
    exits = ways.join(many.select("c", F.col("run").alias("k")), ["c", "k"]).select("c", "k", F.col("ways.exit").alias("x"))
    states = scanned(settle(exits, "exits"), _step_state, _join_exits, [auction.NOTHING], False)
    chosen = ways.join(states, ["c", "k"], "left").select(
        "c", F.col("k").alias("run"), F.element_at("ways", F.coalesce(F.element_at("s", 1), F.lit(0)) + 1).alias("way")
    )
    return settle(runs.join(chosen, ["c", "run"]), "plan")


LINE = {"u": "user", "a": "assistant"}


def _lines(r: dict) -> Iterator[tuple[str, str]]:
    """(role, text) of what stands at a turn after the repair."""
    *before, action = r["action"]
    for x in before:
        yield LINE[x], ""
    if action == "K":
        yield r["role"], r["text"]
    elif action != "D":
        yield LINE[action.lower()], r["text"]
    for x in r["behind"]:
        yield LINE[x], ""


def _with_actions(turns: DataFrame, plan: DataFrame) -> DataFrame:
    """Turns with their action and what is inserted behind them (after the last one only)."""
    narrow = plan.select("c", "run", "start", "last", F.col("way.actions").alias("actions"))
    at = F.col("pos") - F.col("start")
    final = F.col("last") & (at + 2 == F.size("actions"))
    return turns.withColumn("run", F.floor(F.col("pos") / RUN)).join(narrow, ["c", "run"]).select(
        "conv_id", "c", "pos", "role", "text", F.get("actions", at.cast("int")).alias("action"),
        F.when(final, F.element_at("actions", -1)).otherwise("").alias("behind"),
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines; turns arrive in order, and only the hash's state is held."""
    schema = pa.schema([("c", pa.string()), ("repaired_sha256", pa.string())])
    c, state, lines = None, hashlib.sha256(), 0
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["c"] != c:
                if c is not None:
                    out.append({"c": c, "repaired_sha256": state.hexdigest()})
                c, state, lines = r["c"], hashlib.sha256(), 0
            for role, text in _lines(r):
                state.update(b"\n" * (lines > 0) + f"{role}:{text}".encode())
                lines += 1
        yield pa.RecordBatch.from_pylist(out, schema)
    if c is not None:
        yield pa.RecordBatch.from_pylist([{"c": c, "repaired_sha256": state.hexdigest()}], schema)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("c", pa.string()), ("pos", pa.int64()), ("line", pa.int32()), ("role", pa.string()), ("text", pa.string())])
    for batch in batches:
        out = [{"c": r["c"], "pos": r["pos"], "line": i, "role": role, "text": text} for r in batch.to_pylist() for i, (role, text) in enumerate(_lines(r))]
        yield pa.RecordBatch.from_pylist(out, schema)


class Repair:
    """Faults and repair of a table of turns (see ``turns_of``): ``report()`` and the repaired ``rows()``.

    Turns of a conversation are taken by turn, null first, then role and text. Null ids are one conversation. Equal rows
    are duplicates of the first. A conversation of blank turns, or of none that can stay, is repaired to nothing. Roles
    go by their initial; others than s, u and a can only be given a new role or deleted. Other columns are ignored.
    """

    def __init__(self, turns: DataFrame) -> None:
        text_batches(turns.sparkSession)
        self.turns = settle(faulted(numbered(turns)), "faulted")
        self.plan = planned(runs_of(self.turns))

    def rows(self) -> DataFrame:
        """(c, pos, line, role, text) of the repaired conversations, to be ordered by pos and line."""
        return _with_actions(self.turns, self.plan).mapInArrow(_repaired, "c string, pos bigint, line int, role string, text string")

    def report(self) -> DataFrame:
        """One row for each conversation that has turns: gaps, faults, cost, audit and digest, by ``c``."""
        count = {x: F.sum((F.col("fault") == x).cast("long")) for x in ("blank", "duplicate", "truncated")}
        by_turn = self.turns.groupBy("c", "turn").agg(*(F.coalesce(v, F.lit(0)).alias(k) for k, v in count.items()))
        faults = by_turn.groupBy("c").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"), *(F.sum(k).alias(k) for k in count)
        )
        # pairs inside a run, and of its last turn with the next run's first
        after = self.plan.select("c", (F.col("run") - 1).alias("run"), F.left(F.col("roles"), F.lit(1)).alias("next"))
        told = self.plan.join(after, ["c", "run"], "left").withColumn("all", F.concat("roles", F.coalesce("next", F.lit(""))))
        pairs = F.transform(F.sequence(F.lit(1), F.length("all")), lambda i: F.substring(F.col("all"), i, F.lit(2)))
        odd = F.size(F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin("su", "ua", "au"))).cast("long")
        edits = told.groupBy("c").agg(
            F.sum(odd).alias("illegal"), F.max(F.when(F.col("first"), F.col("way.cost"))).alias("cost"),
            F.array_join(F.array_sort(F.collect_list(F.struct("run", F.col("way.edits").alias("e")))).getField("e"), "").alias("audit"),
        )
        ordered = _with_actions(self.turns, self.plan).select("c", "pos", "role", "text", "action", "behind")
        ordered = ordered.repartition("c").sortWithinPartitions("c", "pos")
        hashed = ordered.mapInArrow(_digests, "c string, repaired_sha256 string")
        return faults.join(edits, "c").join(hashed, "c")
