"""Cheapest repair of a run of turns: an auction for the shortest path over a lattice of whole costs.

A node is (turns read, state); the states are nothing yet, after the system turn, after a user turn and
after an assistant turn. Arcs are the edits D(elete), I(nsert), K(eep) and R(erole). The auction keeps a
path from the origin and a price per node. At the path's end it either extends the path by the arc with the
least cost plus price, or, if the end's own price is lower than that, raises it to that and contracts the
path by a node. No price ever exceeds an arc's cost plus the price behind it, so once the path arrives every
shortest path uses tight arcs only (cost plus price behind = own price). The trace follows tight arcs in the
order of their letters and turns back where they lead nowhere, so it is the least of the cheapest edit strings.

A turn is a letter: s, u, a or o(ther) by its role's initial, upper case if it is truncated, x if it must go.
"""

from __future__ import annotations

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: no way
NONE = -1
#: costs after the last turn: the roles must be none, or end with an assistant's
FINAL = [0, NONE, NONE, 0]

_KEEPS = {("s", NOTHING): SYSTEM, ("u", NOTHING): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
_NEEDED = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}


class Lattice:
    """The arcs of a run of turns; ``after`` holds the cost behind each last state, NONE for no way.

    Inserts behind the last turn belong to the next run, unless this one is the ``last``.
    """

    def __init__(self, turns: str, after: list[int], last: bool) -> None:
        n = len(turns)
        self.goal = (n + 1) * STATES
        arcs: list[list[tuple[str, int, int]]] = []
        for i, turn in enumerate([*turns, None]):
            for q in range(STATES):
                out = []
                if turn is None:
                    if after[q] != NONE:
                        out.append(("", after[q], self.goal))
                else:
                    out.append(("D", DELETE, (i + 1) * STATES + q))
                if turn is not None or last:
                    out.append(("I", INSERT, i * STATES + _NEEDED[q]))
                if turn is not None and turn != "x":
                    extra, kind = TRUNCATED * turn.isupper(), turn.lower()
                    if (kind, q) in _KEEPS:
                        out.append(("K", extra, (i + 1) * STATES + _KEEPS[kind, q]))
                    out.append(("R", REROLE + extra, (i + 1) * STATES + _NEEDED[q]))
                arcs.append(out)
        arcs.append([])
        # what cannot reach the goal would be bid up for ever
        behind: list[list[int]] = [[] for _ in arcs]
        for i, out in enumerate(arcs):
            for _, _, j in out:
                behind[j].append(i)
        self.open, todo = {self.goal}, [self.goal]
        while todo:
            for i in behind[todo.pop()]:
                if i not in self.open:
                    self.open.add(i)
                    todo.append(i)
        self.arcs = [[a for a in out if a[2] in self.open] for out in arcs]
        self.price = [0] * len(arcs)

    def cost(self, origin: int) -> int:
        """Cost of the cheapest way from a state before the first turn, or NONE; prices stay for the next origin."""
        if origin not in self.open:
            return NONE
        arcs, price, goal = self.arcs, self.price, self.goal
        path = [origin]
        end = origin
        while end != goal:
            best, to = min((cost + price[j], j) for _, cost, j in arcs[end])
            if price[end] < best:
                price[end] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
            end = path[-1]
        return price[origin]

    def trace(self, origin: int) -> tuple[int, str]:
        """(last state, edits) of the cheapest way with the least string of edits; ``cost`` comes first."""
        dead: set[int] = set()
        path = [(origin, iter(self.arcs[origin]), "")]
        while True:
            node, ways, _ = path[-1]
            for letter, cost, j in ways:
                if cost + self.price[j] == self.price[node] and j not in dead:
                    if j == self.goal:
                        return node % STATES, "".join(x for _, _, x in path)
                    path.append((j, iter(self.arcs[j]), letter))
                    break
            else:
                dead.add(node)
                path.pop()


def matrix(turns: str, last: bool) -> list[int]:
    """Costs from each state before the turns to each state behind them, row by row."""
    columns = []
    for end in range(STATES):
        lattice = Lattice(turns, [0 if q == end else NONE for q in range(STATES)], last)
        columns.append([lattice.cost(q) for q in range(STATES)])
    return [columns[end][q] for q in range(STATES) for end in range(STATES)]


def through(m: list[int], after: list[int]) -> list[int]:
    """Costs before a run from the costs behind it."""
    rows = [[m[q * STATES + e] + after[e] for e in range(STATES) if NONE not in (m[q * STATES + e], after[e])] for q in range(STATES)]
    return [min(r, default=NONE) for r in rows]


def product(m: list[int], n: list[int]) -> list[int]:
    """Costs through two adjacent runs."""
    columns = [through(m, n[e::STATES]) for e in range(STATES)]
    return [columns[e][q] for q in range(STATES) for e in range(STATES)]


def actions(turns: str, state: int, edits: str) -> list[str]:
    """Per turn the initials of roles inserted before it, then K, D, or U / A for a new role; at last what is inserted behind."""
    out, before = [], ""
    for letter in edits:
        if letter == "I":
            state = _NEEDED[state]
            before += "ua"[state == ASSISTANT]
            continue
        if letter == "K":
            state = _KEEPS[turns[len(out)].lower(), state]
        elif letter == "R":
            state = _NEEDED[state]
            letter = "UA"[state == ASSISTANT]
        out.append(before + letter)
        before = ""
    return [*out, before]
