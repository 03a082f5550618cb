"""Hashes of all words of a buffer, without an object per word.

A word's hash is its polynomial in byte values modulo 2^64, taken from running
sums over the whole buffer, then mixed with its length.
"""

from __future__ import annotations

import hashlib

import numpy as np

_BYTES = np.frombuffer(hashlib.shake_128(b"bytes of words").digest(2048), "<u8")
_ODD = np.frombuffer(hashlib.shake_128(b"word multipliers").digest(32), "<u8") | np.uint64(1)
#: Bytes whose sums are taken at a time.
_BLOCK = 1 << 15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def blank_table(blanks: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(blanks)] = True
    return out


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse, up to n."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        undo = np.uint64(pow(int(_ODD[which]), -1, 1 << 64))
        _POWERS[which] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 19), m, np.uint64)])) for m in (_ODD[which], undo))
    return _POWERS[which]


def bounds(raw: np.ndarray, blanks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer."""
    blank = np.concatenate([[True], blanks[raw], [True]])
    return np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of each word; `which` (0 or 1) chooses one of two independent multipliers."""
    h = np.empty(len(starts), np.uint64)
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(raw) + _BLOCK, _BLOCK)))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):  # running sums of a block stay in the cache
        low, high = int(starts[a]), int(ends[b - 1])
        up, down = _powers(which, high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTES[raw[low:high]] * up[:high - low], out=sums[1:])
        at = starts[a:b] - low
        h[a:b] = (sums[ends[a:b] - low] - sums[at]) * down[at]
    h += (ends - starts).astype(np.uint64) * _ODD[2]
    h ^= h >> np.uint64(32)
    h *= _ODD[3]
    return h ^ (h >> np.uint64(29))
