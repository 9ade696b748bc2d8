"""The cheapest repair of one conversation's turns, computed while they stream by.

Turns are kept, given another role, or deleted, and empty turns are inserted, so that the initials of
the roles read `(s?(ua)+)?`. What is allowed next depends on the last initial only, so there are
four states, and after each turn one best way (least cost, then least string of edits) into each of
them. Between two turns the ways are compared by cost and by the order of their strings; strings
of two ways never begin with one another, as each has as many letters other than I as
turns and ends in one. Costs and order relative to the best way take few different values, so a
step is a table entry made when first met ("vector"), and the way back is one entry number per turn.

A way whose cost exceeds the best by more than `HOPELESS` can't win: the difference of what any two
states still have to pay is at most two insertions and a deletion.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
HOPELESS = 2 * COST[INSERT] + COST[DELETE]

# state: role initial -> state. EMPTY is before the first turn, the others are the last initial.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (
    {"s": SYSTEM, "u": USER},
    {"u": USER},
    {"a": ASSISTANT},
    {"u": USER},
)
ENDS = (EMPTY, ASSISTANT)
INSERTED = {USER: "user", ASSISTANT: "assistant"}
# the state after inserting one turn: a user or assistant turn, whichever may follow
_INSERT = tuple(next(s for i, s in n.items() if i in "ua") for n in NEXT)

SOUND, MUST_GO, CUT_SHORT = range(3)  # MUST_GO: blank or duplicate


class Step(NamedTuple):
    """One best way into a state: from which state, what is inserted before the turn, the edit."""

    before: int
    edits: str


class Vector(NamedTuple):
    """The best ways after a turn: cost above the cheapest and place in the order of their
    strings, per state; None where no way leads or none can win."""

    ways: tuple[tuple[int, int] | None, ...]


START = Vector(((0, 0), None, None, None))


def _edits(state: int, initial: str, fault: int) -> Iterator[tuple[int, int, str]]:
    """(new state, cost, edits) for one turn, insertions before it included."""
    cost, inserts = 0, ""
    for _ in range(3):
        yield state, cost + COST[DELETE], inserts + DELETE
        if fault != MUST_GO:
            extra = TRUNCATED_COST if fault == CUT_SHORT else 0
            if initial in NEXT[state]:
                yield NEXT[state][initial], cost + extra, inserts + KEEP
            for role, new in NEXT[state].items():
                if role in "ua":
                    yield new, cost + extra + COST[REROLE], inserts + REROLE
        state, cost, inserts = _INSERT[state], cost + COST[INSERT], inserts + INSERT


class Machine:
    """Steps between vectors, made when first met. A turn is the number of its kind
    (`kind_of`), a step the number of its entry."""

    def __init__(self):
        self.vectors: list[Vector] = [START]
        self.numbers = {START: 0}
        self.moves: dict[tuple[int, str, int], int] = {}
        # entry: the vector after it, what its cheapest way costs more, and its ways back
        self.after: list[int] = []
        self.cost: list[int] = []
        self.back: list[tuple[Step | None, ...]] = []

    def step(self, vector: int, initial: str, fault: int) -> int:
        kind = initial if initial in ("s", "u", "a") else ""
        key = (vector, kind, fault)
        entry = self.moves.get(key)
        if entry is None:
            entry = self.moves[key] = self._make(self.vectors[vector], kind, fault)
        return entry

    def _make(self, vector: Vector, initial: str, fault: int) -> int:
        best: dict[int, tuple[int, int, str, int]] = {}  # cost, order of the string, edits, from
        for state, way in enumerate(vector.ways):
            if way is None:
                continue
            for new, cost, edits in _edits(state, initial, fault):
                offer = (way[0] + cost, way[1], edits, state)
                if new not in best or offer < best[new]:
                    best[new] = offer
        least = min(cost for cost, *_ in best.values())
        best = {s: b for s, b in best.items() if b[0] - least <= HOPELESS}
        # strings: by the one they go on from, then by the letters added
        order = sorted(best, key=lambda s: best[s][1:3])
        ways = tuple(
            (best[s][0] - least, order.index(s)) if s in best else None for s in range(len(NEXT))
        )
        after = Vector(ways)
        if after not in self.numbers:
            self.numbers[after] = len(self.vectors)
            self.vectors.append(after)
        self.after.append(self.numbers[after])
        self.cost.append(least)
        self.back.append(tuple(
            Step(best[s][3], best[s][2]) if s in best else None for s in range(len(NEXT))
        ))
        return len(self.after) - 1

    def end(self, vector: int) -> tuple[int, int, str]:
        """(cost on top, state of the best way, insertions after the last turn)."""
        offers = []
        for state, way in enumerate(self.vectors[vector].ways):
            if way is None:
                continue
            at, cost, inserts = state, way[0], ""
            while at not in ENDS:
                at, cost, inserts = _INSERT[at], cost + COST[INSERT], inserts + INSERT
            offers.append((cost, way[1], inserts, state))
        cost, _, inserts, state = min(offers)
        return cost, state, inserts

    def way_back(self, entries: np.ndarray, state: int) -> tuple[list[str], int]:
        """The edits of each of these turns, for the best way that ends in `state`, and the state
        it starts from."""
        edits = [""] * len(entries)
        back = self.back
        for i in range(len(entries) - 1, -1, -1):
            state, edits[i] = back[entries[i]][state]
        return edits, state

    def origins(self, entry: int, origins: tuple[int | None, ...]) -> tuple[int | None, ...]:
        """For each way after an entry, the state it was in where `origins` began."""
        return tuple(None if s is None else origins[s.before] for s in self.back[entry])


Chunk = Callable[[], tuple[np.ndarray, list]]


class Repair:
    """One conversation, turn by turn.

    Entry numbers and the caller's turns wait in chunks of about `chunk` (in the unit of the sizes
    given to `turn`). When all ways that can still win were in the same state where the newest chunk
    began, the chunks before it are decided. The last chunk before the newest stays in memory;
    `spill` puts earlier ones away and returns what brings them back, so two chunks are held at
    most, however long the ways stay apart."""

    def __init__(self, machine: Machine, spill: Callable[[np.ndarray, list], Chunk], chunk: int):
        self.machine, self.spill, self.chunk = machine, spill, chunk
        self.vector = self.cost = 0
        self._new_chunk()
        self.waiting: list[Chunk] = []
        self.held: tuple[np.ndarray, list] | None = None
        self.state: int | None = None  # of the decided way, where the newest chunk began

    def _new_chunk(self) -> None:
        self.entries: list[int] = []
        self.turns: list = []
        self.size = 0
        self.origins: tuple[int | None, ...] = tuple(range(len(NEXT)))

    def turn(self, initial: str, fault: int, turn, size: int = 1) -> bool:
        """Takes one turn; true if `decided` now has something to give."""
        if self.size >= self.chunk:
            if self.held is not None:
                self.waiting.append(self.spill(*self.held))
            self.held = np.array(self.entries, np.int32), self.turns
            self._new_chunk()
        m = self.machine
        entry = m.step(self.vector, initial, fault)
        self.vector = m.after[entry]
        self.cost += m.cost[entry]
        self.entries.append(entry)
        self.turns.append(turn)
        self.size += size
        if self.held is None:
            return False
        self.origins = m.origins(entry, self.origins)
        where = {o for o in self.origins if o is not None}
        if len(where) > 1:
            return False
        (self.state,) = where
        return True

    def decided(self) -> Iterator[tuple[list[str], list]]:
        """(edits of each turn, turns) of the chunks before the newest one, in order."""
        chunks, held = self.waiting, self.held
        self.waiting, self.held = [], None
        yield from self._way([*chunks, lambda: held], self.state)

    def finish(self) -> tuple[str, Iterator[tuple[list[str], list]]]:
        """The insertions after the last turn, and all that `decided` has not given."""
        cost, state, inserts = self.machine.end(self.vector)
        self.cost += cost
        chunks = self.waiting if self.held is None else [*self.waiting, lambda: self.held]
        newest = np.array(self.entries, np.int32), self.turns
        return inserts, self._way([*chunks, lambda: newest], state)

    def _way(self, chunks: list[Chunk], state: int) -> Iterator[tuple[list[str], list]]:
        """Back through the chunks for the edits, then forward with the turns."""
        edits = []
        for load in reversed(chunks):
            found, state = self.machine.way_back(load()[0], state)
            edits.append("\n".join(found))  # a letter or a few per turn
        for load, found in zip(chunks, reversed(edits)):
            yield found.split("\n"), load()[1]


def roles(state: int, edits: str, initial: str) -> tuple[int, list[tuple[str, int]]]:
    """The state after a turn's edits, and (edit, state after it) of each, from the state before."""
    made = []
    for edit in edits:
        if edit == KEEP:
            state = NEXT[state][initial]
        elif edit != DELETE:
            state = _INSERT[state]
        made.append((edit, state))
    return state, made
