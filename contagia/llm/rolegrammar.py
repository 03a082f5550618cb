"""Cheapest edits of many turn sequences at once, over a shared grammar.

A sequence has one symbol per turn: its role and whether it is truncated or
has to go. Re-Pair replaces the most frequent adjacent pairs of all sequences
by new symbols until no pair occurs twice; what is left of a sequence is then
paired up to one symbol. Every symbol has one min-plus matrix over the states
of a legal conversation: the least cost from state to state, the state in the
middle (which makes the edits a rope), and the order of the edits that lead
from one state to the different ones. Edits of one symbol that end in different
states are different and never begin with one another, so of equal costs the
least edits follow from these orders alone, and no strings are compared.
"""

from __future__ import annotations

import re

import numpy as np

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = "KRDI"
#: Turns that have to be deleted; all others are 1 + 2 * role (none, system, user, assistant) + truncated.
GONE = 0
N_SYMBOLS = 9
FAR = 1 << 40
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: The state after the next user or assistant turn, from each state.
SPOKEN = (USER, USER, ASSISTANT, USER)
#: Turns missing at the end, from each state.
MISSING = (0, 2, 1, 0)


def symbol(role: int, truncated: bool) -> int:
    return 1 + 2 * role + truncated


def _steps(state: int, sym: int) -> list[tuple[int, str, int]]:
    """(cost, edits, state after) of everything that can be done with a turn, with turns inserted before it."""
    out, cost, edits = [], 0, ""
    role, late = (0, 0) if sym == GONE else ((sym - 1) // 2, (sym - 1) % 2)
    for _ in range(3):
        out.append((cost + COST[DELETE], edits + DELETE, state))
        if sym != GONE:
            out.append((cost + COST[REROLE] + late, edits + REROLE, SPOKEN[state]))
            if role == SYSTEM and state == START or role in (USER, ASSISTANT) and SPOKEN[state] == role:
                out.append((cost + late, edits + KEEP, role))
        cost, edits, state = cost + COST[INSERT], edits + INSERT, SPOKEN[state]
    return out


def _terminals() -> tuple[np.ndarray, np.ndarray, list]:
    cost, rank = np.full((N_SYMBOLS, 4, 4), FAR), np.zeros((N_SYMBOLS, 4, 4), np.int64)
    edits = [[[""] * 4 for _ in range(4)] for _ in range(N_SYMBOLS)]
    for sym in range(N_SYMBOLS):
        for s in range(4):
            for t in range(4):
                best = min((x[:2] for x in _steps(s, sym) if x[2] == t), default=(FAR, "~"))
                cost[sym, s, t], edits[sym][s][t] = best
            order = sorted(range(4), key=lambda t: edits[sym][s][t])
            rank[sym, s, order] = range(4)
    return cost, rank, edits


_COST, _RANK, _EDITS = _terminals()


def _product(cost_l: np.ndarray, rank_l: np.ndarray, cost_r: np.ndarray, rank_r: np.ndarray) -> tuple[np.ndarray, ...]:
    """Matrices (cost, rank, middle state) of pairs of symbols."""
    key = (cost_l[:, :, :, None] + cost_r[:, None]) * 4 + rank_l[:, :, :, None]
    mid = key.argmin(axis=2)
    cost = np.minimum(key.min(axis=2) // 4, FAR)
    rows = np.arange(len(cost_l))[:, None, None]
    order = (cost == FAR) * 64 + rank_l[rows, np.arange(4)[None, :, None], mid] * 4 + rank_r[rows, mid, np.arange(4)]
    return cost, order.argsort(axis=2, kind="stable").argsort(axis=2, kind="stable"), mid


class Grammar:
    """Sequences of symbols (bytes) under one grammar; `root` has the symbol of each (-1: it is empty)."""

    def __init__(self, sequences: list[bytes]) -> None:
        self.cost, self.rank = _COST, _RANK
        self._mid: list[np.ndarray] = [np.zeros((N_SYMBOLS, 4, 4), np.int64)]
        self._pair: list[np.ndarray] = [np.full((N_SYMBOLS, 2), -1)]
        size = np.array([len(x) for x in sequences], np.int64)
        line = np.repeat(np.arange(len(size)), size)
        syms = np.frombuffer(b"".join(sequences), np.uint8).astype(np.int64)
        syms, line = self._repair(syms, line)
        while len(line) and (line[1:] == line[:-1]).any():
            place = np.arange(len(line)) - np.searchsorted(line, line)
            syms, line = self._replace(syms, line, np.flatnonzero((line[1:] == line[:-1]) & (place[:-1] % 2 == 0)))
        self.root = np.full(len(size), -1)
        self.root[line] = syms
        self._mids, self._pairs = np.concatenate(self._mid), np.concatenate(self._pair)

    def _replace(self, syms: np.ndarray, line: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New symbols for the (disjoint) pairs at these places, one for each kind of pair."""
        kinds, which = np.unique(syms[at] << 32 | syms[at + 1], return_inverse=True)
        left, right = kinds >> 32, kinds & 0xFFFFFFFF
        cost, rank, mid = _product(self.cost[left], self.rank[left], self.cost[right], self.rank[right])
        syms = syms.copy()
        syms[at] = len(self.cost) + which
        self.cost, self.rank = np.concatenate([self.cost, cost]), np.concatenate([self.rank, rank])
        self._mid.append(mid)
        self._pair.append(np.stack([left, right], axis=1))
        kept = np.ones(len(syms), bool)
        kept[at + 1] = False
        return syms[kept], line[kept]

    def _repair(self, syms: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Most frequent pairs first; pairs that have no symbol in common are replaced in one pass."""
        while len(syms) > 1:
            at = np.flatnonzero(line[1:] == line[:-1])
            kinds, which, n = np.unique(syms[at] << 32 | syms[at + 1], return_inverse=True, return_counts=True)
            taken, used = np.zeros(len(kinds), bool), set()
            for k in np.argsort(-n, kind="stable"):
                if n[k] < 2 or len(used) > 2000:
                    break
                pair = {int(kinds[k] >> 32), int(kinds[k] & 0xFFFFFFFF)}
                if not pair & used:
                    used |= pair
                    taken[k] = True
            at = at[taken[which]]
            # In a run of one symbol only every second place holds a pair of its own.
            run = np.append(True, np.diff(at) != 1) if len(at) else np.zeros(0, bool)
            at = at[(at - at[np.flatnonzero(run)][np.cumsum(run) - 1]) % 2 == 0]
            if not len(at):
                return syms, line
            syms, line = self._replace(syms, line, at)
        return syms, line

    def edits(self, root: int, start: int, end: int) -> str:
        """The rope from one state to another, as a string."""
        out, todo = [], [(root, start, end)] if root >= 0 else []
        while todo:
            sym, s, t = todo.pop()
            if sym < N_SYMBOLS:
                out.append(_EDITS[sym][s][t])
            else:
                mid = self._mids[sym, s, t]
                left, right = self._pairs[sym]
                todo += [(right, mid, t), (left, s, mid)]
        return "".join(out)

    def best_end(self, root: int, start: int = START) -> int:
        """The end state of the cheapest legal repair, with what is missing at the end."""
        if root < 0:
            return start
        return min(range(4), key=lambda t: (self.cost[root, start, t] + COST[INSERT] * MISSING[t], self.rank[root, start, t]))


def closing(state: int) -> str:
    return INSERT * MISSING[state]


def per_turn(edits: str) -> list[str]:
    """The edits of every turn, with the insertions before it; insertions at the end come last, alone."""
    parts = re.findall("I*[KRD]", edits)
    tail = edits[sum(map(len, parts)):]
    return [*parts, tail] if tail else parts


def apply(edits: str, state: int, role: int) -> tuple[list[int], int | None, int]:
    """Roles inserted before a turn, the role it is given (None: it goes or there is none), and the state after it."""
    inserted = []
    for edit in edits:
        if edit == DELETE:
            return inserted, None, state
        state = role if edit == KEEP else SPOKEN[state]
        if edit != INSERT:
            return inserted, state, state
        inserted.append(state)
    return inserted, None, state
