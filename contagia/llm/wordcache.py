"""Ids of the words of a buffer, with each distinct word encoded once.

Words are looked up by two 64-bit hashes in sorted arrays, so a known word never
becomes an object. The arrays are bounded: they come in two generations, and
when the younger one is full, words not met since it began are forgotten.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pandas as pd

from contagia.llm import wordhash


class _Generation:
    def __init__(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Place of every key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[place] == keys) & (self.checks[place] == checks), place, -1)

    def add(self, keys: np.ndarray, checks: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Further entries, in the order of their keys."""
        into = np.searchsorted(self.keys, keys)
        for name, value in (("keys", keys), ("checks", checks), ("at", len(self.ids) + np.cumsum(size) - size), ("size", size)):
            setattr(self, name, np.insert(getattr(self, name), into, value))
        self.ids = np.concatenate([self.ids, ids])


def gather(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[at:at + size] of every entry, one after the other."""
    return values[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def flat(lists: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists one after the other, and the length of each."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum())), size


class WordCache:
    """`encode` gives the ids of some words, one after the other, and the number of ids of each."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], entries: int = 1_000_000) -> None:
        self._encode, self._half = encode, entries // 2
        self._young, self._old = _Generation(), _Generation()

    def _fresh(self, whole: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return self._encode([whole[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist())])

    def encode(self, whole: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each."""
        raw = np.frombuffer(whole, np.uint8)
        keys, checks = (wordhash.hashes(raw, starts, ends, k) for k in (0, 1))
        word, keys = pd.factorize(keys)
        first = np.empty(len(keys), np.int64)
        first[word[::-1]] = np.arange(len(word))[::-1]
        order = np.argsort(keys)  # keys in order are found faster
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        keys, first, word = keys[order], first[order], place[word]
        if (checks != checks[first][word]).any():  # two words share one hash
            return self._fresh(whole, starts, ends)
        checks = checks[first]
        young = self._young.find(keys, checks)
        old = np.where(young < 0, self._old.find(keys, checks), -1)
        missing = (young < 0) & (old < 0)
        ids, size_new = self._fresh(whole, starts[first[missing]], ends[first[missing]])
        at, size = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        base = 0
        for known, place, hit in ((self._young, young, young >= 0), (self._old, old, old >= 0)):
            at[hit], size[hit] = base + known.at[place[hit]], known.size[place[hit]]
            base += len(known.ids)
        at[missing], size[missing] = base + np.cumsum(size_new) - size_new, size_new
        values = np.concatenate([self._young.ids, self._old.ids, ids])
        self._remember(keys, checks, at, size, values, young < 0)
        return gather(values, at[word], size[word]), size[word]

    def _remember(self, keys: np.ndarray, checks: np.ndarray, at: np.ndarray, size: np.ndarray, values: np.ndarray, new: np.ndarray) -> None:
        if len(self._young.keys) + int(new.sum()) > self._half and len(self._young.keys):
            self._old, self._young = self._young, _Generation()
        new = np.flatnonzero(new)
        if len(self._young.keys):  # one word for each hash
            place = np.minimum(np.searchsorted(self._young.keys, keys[new]), len(self._young.keys) - 1)
            new = new[self._young.keys[place] != keys[new]]
        self._young.add(keys[new], checks[new], size[new], gather(values, at[new], size[new]))
