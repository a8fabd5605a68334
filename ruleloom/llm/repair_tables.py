"""Cheapest repair of a turn sequence, by tables over blocks of symbols (Four Russians).

A conversation is a string over nine symbols: the role (system, user, assistant, other) of a sound turn, the same of a truncated
one, or a turn that has to go.  A repair is a walk through four states, the last role written; the costs to go from all
states form a vector, which, less its least value, is one of a few.  So what a block of symbols does to a vector of costs
can be tabulated once: which vector comes out in front of the block, and how much the least value grew.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Costs of the edits; a truncated turn that stays costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
# The state after a turn of this state's successor; inserted and rerolled turns take its role.
AFTER = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
# Which roles a turn may keep in a state, and the state after it.
KEEPS = {NOTHING: {0: SYSTEM, 1: USER}, SYSTEM: {1: USER}, USER: {2: ASSISTANT}, ASSISTANT: {1: USER}}
INITIALS = "sua"
TRUNCATED_FROM, GONE, SYMBOLS = 4, 8, 9
BLOCK = 4


def symbol(initial: str, truncated: bool) -> int:
    kind = INITIALS.find(initial) if initial else -1
    return (kind if kind >= 0 else 3) + TRUNCATED_FROM * truncated


def _inserted(cost: list[int]) -> tuple[int, ...]:
    """Costs to go if turns may be inserted first."""
    user, assistant = min(cost[USER], INSERT + cost[ASSISTANT]), min(cost[ASSISTANT], INSERT + cost[USER])
    return min(cost[NOTHING], INSERT + user), min(cost[SYSTEM], INSERT + user), user, assistant


def _edits(state: int, s: int) -> list[tuple[str, int, int]]:
    """What may be done to a turn of symbol ``s``, in the order of the initials: initial, cost, state after it."""
    found = [("D", DELETE, state)]
    if s != GONE:
        more = TRUNCATED * (s >= TRUNCATED_FROM)
        kept = KEEPS[state].get(s % TRUNCATED_FROM)
        if kept is not None:
            found.append(("K", KEEP + more, kept))
        found.append(("R", REROLE + more, AFTER[state]))
    return found


class Tables:
    """``vectors`` are the normalised costs to go; the first is the one behind the last turn.

    ``step_to[v, s]`` and ``step_cost[v, s]``: the vector in front of symbol ``s`` and the growth of its least value, if ``v`` is the
    vector behind it; ``block_to`` and ``block_cost`` the same for ``BLOCK`` symbols at once, numbered in base ``SYMBOLS``
    with the first symbol as the lowest digit.  ``edits[v, s, state]``: the edits of a symbol, its ASCII-least
    cheapest ones, with the insertions before it; ``state_after`` and ``edit_cost`` belong to them.
    """

    def __init__(self):
        end = _inserted([0, INSERT * 9, INSERT * 9, 0])
        vectors = {end: 0}
        to, cost, edits, after, spent = [], [], [], [], []
        todo = [end]
        for vector in todo:
            rows = [[] for _ in range(5)]
            for s in range(SYMBOLS):
                here = _inserted([min(c + vector[t] for _, c, t in _edits(state, s)) for state in range(4)])
                least = min(here)
                normal = tuple(x - least for x in here)
                if normal not in vectors:
                    vectors[normal] = len(vectors)
                    todo.append(normal)
                traced = [self._trace(state, s, here, vector) for state in range(4)]
                for row, value in zip(rows, (vectors[normal], least, *zip(*traced, strict=True)), strict=True):
                    row.append(value)
            for table, row in zip((to, cost, edits, after, spent), rows, strict=True):
                table.append(row)
        self.vectors = list(vectors)
        self.step_to, self.step_cost = np.array(to, dtype=np.int16), np.array(cost, dtype=np.int64)
        self.edits, self.state_after, self.edit_cost = edits, np.array(after, dtype=np.int8), spent
        self.plain_to, self.plain_after = self.step_to.tolist(), self.state_after.tolist()

        blocks = np.arange(SYMBOLS ** BLOCK)
        self.block_to = np.repeat(np.arange(len(vectors), dtype=np.int16)[:, None], len(blocks), axis=1)
        self.block_cost = np.zeros_like(self.block_to, dtype=np.int64)
        for place in reversed(range(BLOCK)):
            digit = np.broadcast_to(blocks // SYMBOLS ** place % SYMBOLS, self.block_to.shape)
            self.block_cost += self.step_cost[self.block_to, digit]
            self.block_to = self.step_to[self.block_to, digit]

    @staticmethod
    def _trace(state: int, s: int, here: tuple[int, ...], behind: tuple[int, ...]) -> tuple[str, int, int]:
        """The edits up to and with this symbol, the state after them and their cost: at each place the least initial that
        keeps to the least cost (D before I before K before R)."""
        done, paid = "", 0
        while True:
            for initial, cost, after in _edits(state, s):
                if initial != "D" and INSERT + here[AFTER[state]] == here[state]:
                    break
                if cost + behind[after] == here[state]:
                    return done + initial, after, paid + cost
            done, state, paid = done + "I", AFTER[state], paid + INSERT

    @staticmethod
    def ending(state: int) -> str:
        """Insertions behind the last turn."""
        return {USER: "I", SYSTEM: "II"}.get(state, "")

    def _blocks(self, symbols: np.ndarray) -> tuple[np.ndarray, int]:
        """Numbers of the blocks, which end where the symbols end, and how many symbols are left in front of them."""
        rest = len(symbols) % BLOCK
        digits = symbols[rest:].reshape(-1, BLOCK).astype(np.int64)
        return digits @ (SYMBOLS ** np.arange(BLOCK)), rest

    def trace(self, symbols: np.ndarray, behind: int, state: int) -> tuple[list[str], int, int]:
        """Edits per symbol, the state after them, their cost; ``behind`` is the vector behind the last symbol.

        Blocks are looked up from the last to the first for the vectors at their borders; then, from the first to the last,
        each is expanded backward into the vectors at all its places, which decide between edits of equal cost.
        """
        numbers, rest = self._blocks(symbols)
        borders = [behind]
        for number in numbers[::-1].tolist():
            borders.append(int(self.block_to[borders[-1], number]))
        plain = symbols.tolist()
        done, paid, start = [], 0, 0
        lengths = ([rest] if rest else []) + [BLOCK] * len(numbers)
        rights = ([borders[-1]] if rest else []) + borders[:-1][::-1]
        for length, right in zip(lengths, rights, strict=True):
            vectors = [right]
            for s in reversed(plain[start + 1:start + length]):
                vectors.append(self.plain_to[vectors[-1]][s])
            for s in plain[start:start + length]:
                v = vectors.pop()
                done.append(self.edits[v][s][state])
                paid += self.edit_cost[v][s][state]
                state = self.plain_after[v][s][state]
            start += length
        return done, state, paid

    def summary(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector behind the symbols the one in front of them, and for each such vector and each state in front the
        state behind: what neighbours of this piece have to know."""
        numbers, rest = self._blocks(symbols)
        borders = [np.arange(len(self.vectors))]
        for number in numbers[::-1].tolist():
            borders.append(self.block_to[borders[-1], number])
        places = [*borders[::-1]] if not rest else [None, *borders[::-1]]
        state = np.tile(np.arange(4), (len(self.vectors), 1))
        front, start = borders[-1], 0
        for length, right in zip(([rest] if rest else []) + [BLOCK] * len(numbers), places[1:], strict=True):
            vectors = [right]
            for s in reversed(symbols[start + 1:start + length]):
                vectors.append(self.step_to[vectors[-1], s])
            if not start:
                front = self.step_to[vectors[-1], symbols[0]]
            for s in symbols[start:start + length]:
                state = self.state_after[vectors.pop()[:, None], s, state]
            start += length
        return np.asarray(front, dtype=np.int16), state.astype(np.int8)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()
