"""Benchmark passages in documents, by q-gram lemma filtering.

An item is in a document if one of its windows of `window` characters (of the
whole item, if it is shorter) is, within an edit budget. Windows start every
`stride` characters, and one ends with the item. White space counts as one
space and case is ignored.

A window of length w within k edits shares at least w + 1 - q - k q of its
character q-grams, all on diagonals that differ by k at most. So texts are
searched in three steps, none of which can lose a match:

1. positions whose q-gram is in any item are marked; stretches without enough
   marks are dropped;
2. shared q-grams are counted by item and band of diagonals; a band is twice as
   wide as its step, so any range of diagonals of a match lies whole in one;
3. bands that reach the bound are verified by banded alignment.

The benchmark is a stated query set: it is taken in blocks of bounded size, and
each block is held against all documents.

Items too short for a full budget at this q are searched with a smaller one, in
blocks of their own. Those that are too short for an edit are looked for as they
are, between word borders.

Defined results: null texts are empty; items without a character match nothing,
nor do those shorter than `min_chars`, of which `EVERY`, which the query and the
pipeline take, leaves none out, with windows from every character; repeated items and rows give a row each; extra
columns are left behind by `find` and kept by `drop_contaminated`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contagia.llm.common import text_chunks, whole_text

_ODD = np.frombuffer(hashlib.shake_128(b"q-gram multipliers").digest(24), "<u8") | np.uint64(1)
_ODD32 = (_ODD[1:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_BITS = 23
#: Pairs of places of one q-gram, in a text and in the items, that are listed one by one; more are summed as progressions.
_LISTED = 4096
#: Bands of a text and an item that are verified together, in turn; an exact find ends the search.
_WAVES = (1, 8, 64)
_NOTHING = 0xFFFFFFFF
#: Characters between the windows that are aligned first.
_APART = 10
#: A character of a word, in scripts that put spaces between words.
_WORD = r"[^\W\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]"


@dataclass(frozen=True)
class LeakParams:
    q: int = 10
    window: int = 100
    stride: int = 10
    edit_percent: int = 8
    min_chars: int = 40
    #: Characters of items in one block of the query set.
    block_chars: int = 1 << 20

    def budget(self, width: int) -> int:
        """Edits allowed in a window; few enough that it must share a q-gram."""
        return max(0, min(width * self.edit_percent // 100, (width - self.q) // self.q))


#: No least length of items, and no window left out.
EVERY = LeakParams(stride=1, min_chars=1)


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _marks(codes: np.ndarray, q: int) -> np.ndarray:
    """A 32-bit polynomial of the q-gram at every position, from those of powers of two."""
    n, out, done = len(codes) - q + 1, None, 0
    if n <= 0:
        return np.zeros(0, np.uint32)
    level, size, power = codes.astype(np.uint32), 1, int(_ODD32[0])
    while size <= q:
        if q & size:
            part = level[done:done + n]
            out, done = part if out is None else out * np.uint32(power) + part, done + size
        if size * 2 <= q:
            level = level[:-size] * np.uint32(power) + level[size:]
            power = power * power & 0xFFFFFFFF
        size *= 2
    return (out ^ (out >> np.uint32(15))) * _ODD32[1]


def _grams(codes: np.ndarray, at: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q-gram at some positions."""
    h = np.zeros(len(at), np.uint64)
    for k in range(q):
        h = (h + codes[at + k].astype(np.uint64) + np.uint64(1)) * _ODD[0]
        h ^= h >> np.uint64(29)
    return h


def _progressions(places: np.ndarray) -> list[tuple[int, int, int]]:
    """Ascending places as (first, step, number) of maximal runs with one distance."""
    if len(places) < 2:
        return [(int(p), 1, 1) for p in places]
    gaps = np.diff(places)
    out, i, edges = [], 0, np.append(np.flatnonzero(gaps[1:] != gaps[:-1]) + 1, len(gaps))
    for edge in edges.tolist():  # the distances up to `edge` are equal
        if i <= edge:
            out.append((int(places[i]), int(gaps[edge - 1]), edge - i + 1))
            i = edge + 1
    if i < len(places):
        out.append((int(places[i]), 1, 1))
    return out


class Block:
    """Items of one block, with an index of their q-grams."""

    def __init__(self, items: list[tuple[int | None, str]], params: LeakParams) -> None:
        self.params = params
        kept = [(i, normalise(t or "")) for i, t in items]
        kept = [(i, t) for i, t in kept if len(t) >= params.min_chars]
        self.ids = [i for i, _ in kept]
        self.codes = [_codes(t) for _, t in kept]
        self.widths = np.array([min(params.window, len(c)) for c in self.codes], np.int64)
        self.budgets = np.array([params.budget(int(w)) for w in self.widths], np.int64)
        self.bounds = self.widths + 1 - params.q - params.q * self.budgets
        counts = [max(0, len(c) - params.q + 1) for c in self.codes]
        flat = np.concatenate([np.zeros(0, np.uint64), *(_grams(c, np.arange(n), params.q) for c, n in zip(self.codes, counts))])
        item = np.repeat(np.arange(len(counts)), counts)
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(n) for n in counts)])
        order = np.argsort(flat, kind="stable")
        self.grams, first = np.unique(flat[order], return_index=True)
        self.cuts = np.append(first, len(flat))
        self.item, self.place = item[order], place[order]
        self.bits = min(_BITS, max(16, int(len(flat)).bit_length() + 5))
        self.marks = np.zeros(1 << self.bits, bool)
        for c in self.codes:
            self.marks[_marks(c, params.q) >> np.uint32(32 - self.bits)] = True

    def find(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item, edits) for every item found in every text, by their index."""
        q = self.params.q
        if not self.codes:
            return []
        parts = [_codes(normalise(t)) for t in texts]
        gap = np.full(q, _NOTHING, np.uint32)
        sizes = np.array([len(p) + q for p in parts], np.int64)
        starts = np.cumsum(sizes) - sizes
        codes = np.concatenate([x for p in parts for x in (p, gap)])
        n = len(codes) - q + 1
        # Step 1: enough marks, of whatever item, within the reach of one window.
        marked = self.marks[_marks(codes, q) >> np.uint32(32 - self.bits)]
        least = int(self.bounds.min())
        reach = int((self.widths + self.budgets).max()) - q + 1
        total = np.zeros(n + reach + 1, np.int32)
        np.cumsum(marked, dtype=np.int32, out=total[1:n + 1])
        total[n + 1:] = total[n]
        rich = np.flatnonzero(total[reach:reach + n] - total[:n] >= least)
        if not len(rich):
            return []
        edge = np.zeros(n + 1, np.int32)
        edge[rich] += 1
        np.add.at(edge, np.minimum(rich + reach, n), -1)
        spots = np.flatnonzero(marked & (np.cumsum(edge[:-1]) > 0))
        grams = _grams(codes, spots, q)
        where = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        true = self.grams[where] == grams
        spots, where = spots[true], where[true]
        if not len(spots):
            return []
        # Step 2: shared q-grams by text, item and band of diagonals.
        text = np.searchsorted(starts, spots, side="right") - 1
        order = np.lexsort((spots, where, text))
        spots, where, text = spots[order], where[order], text[order]
        same = np.append(False, (text[1:] == text[:-1]) & (where[1:] == where[:-1]))
        first = np.flatnonzero(~same)
        met, posts = np.diff(np.append(first, len(spots))), (self.cuts[where + 1] - self.cuts[where])
        heavy = met * posts[first] > _LISTED
        found = [self._progressed(int(text[f]), int(where[f]), spots[f:f + m] - starts[text[f]]) for f, m in zip(first[heavy], met[heavy])]
        listed = np.flatnonzero(~np.repeat(heavy, met))
        ends = np.cumsum(posts[listed])
        lo = 0
        while lo < len(listed):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20), side="right")))
            some = listed[lo:hi]
            found.append(self._bands(spots[some] - starts[text[some]], text[some], where[some]))
            lo = hi
        if not found:
            return []
        keys, n_shared = (np.concatenate(x, axis=-1) for x in zip(*found))
        keys, which = np.unique(keys, axis=1, return_inverse=True)
        n_shared = np.bincount(which.ravel(), n_shared, keys.shape[1])
        enough = n_shared >= self.bounds[keys[1]]
        return self._verify(keys[:, enough], n_shared[enough], codes, starts, sizes - q)

    def _bands(self, spot: np.ndarray, text: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.cuts[where + 1] - self.cuts[where]
        post = np.repeat(self.cuts[where] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item = self.item[post]
        band = (np.repeat(spot, n) - self.place[post]) // (self.budgets[item] + 1)
        text = np.repeat(text, n)
        return np.unique(np.concatenate([np.stack([text, item, band]), np.stack([text, item, band - 1])], axis=1), axis=1, return_counts=True)

    def _progressed(self, text: int, where: int, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for one q-gram of many places: two progressions of one step meet on few diagonals, each known times."""
        keys, counts, posts = [], [], slice(int(self.cuts[where]), int(self.cuts[where + 1]))
        own = _progressions(spots)
        for item in np.unique(self.item[posts]).tolist():
            width, sums = int(self.budgets[item]) + 1, []
            for p, gap, b in _progressions(np.sort(self.place[posts][self.item[posts] == item])):
                for s, step, a in own:
                    if step == gap or a == 1 or b == 1:
                        step = step if a > 1 else gap
                        k = np.arange(1 - b, a)
                        sums.append((s - p + step * k, np.minimum(a - 1, k + b - 1) - np.maximum(0, k) + 1))
                    else:
                        short, long = ((s + step * np.arange(a)), (p + gap * np.arange(b)))
                        for x in (short if a <= b else long).tolist():
                            d = x - long if a <= b else short - x
                            sums.append((d, np.ones(len(d), np.int64)))
            diagonal, n = (np.concatenate(x) for x in zip(*sums))
            low = int(diagonal.min()) // width - 1
            total = np.bincount(diagonal // width - low, n) + np.append(np.bincount(diagonal // width - 1 - low, n), 0)
            band = np.flatnonzero(total)
            keys.append(np.stack([np.full(len(band), text), np.full(len(band), item), band + low]))
            counts.append(total[band].astype(np.int64))
        return np.concatenate(keys, axis=1), np.concatenate(counts)

    def _distinct(self, keys: np.ndarray, n: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the bands of a text and an item that lie over the same characters, one is enough."""
        text, item, band = keys
        pair, size = np.unique(np.stack([text, item]), axis=1, return_inverse=True, return_counts=True)[1:]
        many = size[pair.ravel()] > _WAVES[-1]
        if not many.any():
            return keys, n
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(codes), _ODD[0])]))
        undo = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(codes), np.uint64(pow(int(_ODD[0]), -1, 1 << 64)))]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:-1])])
        k = self.budgets[item]
        begin = band * (k + 1) - k
        end = begin + np.array([len(c) for c in self.codes])[item] + 4 * k + 2
        lo, hi = np.clip(begin, 0, lengths[text]), np.clip(end, 0, lengths[text])
        over = (sums[starts[text] + hi] - sums[starts[text] + lo]) * undo[starts[text] + lo]
        alone = np.where(many, 0, np.arange(1, len(n) + 1))
        order = np.argsort(-n, kind="stable")
        seen = np.stack([text, item, lo - begin, end - hi, over.view(np.int64), alone])[:, order]
        kept = np.sort(order[np.unique(seen, axis=1, return_index=True)[1]])
        return keys[:, kept], n[kept]

    def _verify(self, keys: np.ndarray, n: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
        keys, n = self._distinct(keys, n, codes, starts, lengths)
        best: dict[tuple[int, int], int] = {}
        costs: dict[tuple[int, int, int, int], int] = {}
        bands: dict[tuple[int, int], list[int]] = {}
        for k in np.lexsort((-n, keys[1], keys[0])):
            bands.setdefault((int(keys[0, k]), int(keys[1, k])), []).append(int(keys[2, k]))
        lo = 0
        for hi in (*_WAVES, max([len(x) for x in bands.values()], default=0)):
            self._wave([(*pair, band) for pair, own in bands.items() if best.get(pair) != 0 for band in own[lo:hi]], best, costs, codes, starts, lengths)
            lo = max(lo, hi)
        return [(t, i, e) for (t, i), e in sorted(best.items())]

    def _wave(self, wanted: list[tuple[int, int, int]], best: dict, costs: dict, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        def align(jobs: list[tuple[int, int, int, int]]) -> None:
            by: dict[int, list[tuple[int, int, int, int]]] = {}
            for job in jobs:
                by.setdefault(int(self.widths[job[1]]), []).append(job)
            for width, rows in by.items():
                for lo in range(0, len(rows), 2048):
                    some = rows[lo:lo + 2048]
                    for job, edits in zip(some, self._align(width, some, codes, starts, lengths)):
                        costs[job] = int(edits)
                        if edits <= self.budgets[job[1]]:
                            best[job[:2]] = min(int(edits), best.get(job[:2], width))

        # Windows that start d characters apart differ by d edits at most, so most are ruled out by those at a distance.
        coarse, fine = [], []
        for text, item, band in wanted:
            last, diagonal = len(self.codes[item]) - int(self.widths[item]), band * (int(self.budgets[item]) + 1)
            own = sorted({*range(0, last + 1, self.params.stride), last})
            tried = sorted({*own[::max(1, _APART // self.params.stride)], last})
            coarse += [(text, item, at, diagonal) for at in tried]
            fine += [(text, item, diagonal, lo, hi) for lo, hi in zip(tried, tried[1:]) if hi - lo > self.params.stride]
        align(coarse)
        rest = []
        for text, item, diagonal, lo, hi in fine:
            most = min(int(self.budgets[item]), best.get((text, item), 1 << 30) - 1)
            left, right = costs[text, item, lo, diagonal], costs[text, item, hi, diagonal]
            rest += [(text, item, at, diagonal) for at in range(lo + self.params.stride, hi, self.params.stride)
                     if left - (at - lo) <= most and right - (hi - at) <= most]
        align(rest)

    def _align(self, width: int, rows: list[tuple[int, int, int, int]], codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Least edits of each window inside its band; both ends of the text are free."""
        text, item, at, diagonal = (np.array(x, np.int64) for x in zip(*rows))
        windows = np.stack([self.codes[i][a:a + width] for i, a in zip(item, at)])
        k = int(self.budgets[item].max())
        columns = np.arange(2 * (k + 1) + 2 * k)
        first = (at + diagonal - k)[:, None] + columns
        begin, length = starts[text][:, None], lengths[text][:, None]
        cost = np.zeros((len(rows), len(columns)), np.int32)
        for i in range(width):
            place = first + i
            inside = (place >= 0) & (place < length)
            same = inside & (codes[np.where(inside, begin + place, 0)] == windows[:, i, None])
            step = cost + ~same
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(step - columns, axis=1) + columns
        return cost.min(axis=1)


class Phrases:
    """Items of one block that are too short for an edit."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        self.ids = [i for i, _ in items]
        self.items = [normalise(t) for _, t in items]
        self.patterns = [re.compile(f"(?<!{_WORD})" * bool(re.match(_WORD, t)) + re.escape(t) + f"(?!{_WORD})" * bool(re.match(_WORD, t[-1])))
                         for t in self.items]
        self.of: dict[str, list[int]] = {}
        for i, t in enumerate(self.items):
            self.of.setdefault(t, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for t in self.of:
            self.automaton.add_word(t, t)
        self.automaton.make_automaton()

    def find(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item, 0) as in a block."""
        out = []
        for k, text in enumerate(map(normalise, texts)):
            met = {t for _, t in self.automaton.iter(text)}
            out += [(k, i, 0) for i in sorted(i for t in met if self.patterns[self.of[t][0]].search(text) for i in self.of[t])]
        return out


def _block(items: list[tuple[int | None, str]], params: LeakParams) -> Iterator[Block | Phrases]:
    """The items by the largest q up to that of `params` with which none loses an edit of its budget."""
    by: dict[int, list[tuple[int | None, str]]] = {}
    for i, t in items:
        width = min(params.window, len(normalise(t)))
        edits = width * params.edit_percent // 100
        if width >= max(params.min_chars, 1):
            by.setdefault(min(params.q, width // (edits + 1)) if edits else 0, []).append((i, t))
    for q, some in sorted(by.items(), reverse=True):
        yield Block(some, replace(params, q=q)) if q else Phrases(some)


def blocks(benchmark: DataFrame, params: LeakParams, id_col: str = "item_id", text_col: str = "text") -> Iterator[Block | Phrases]:
    """The query set in blocks of bounded size."""
    items, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL")
    for row in rows.toLocalIterator():
        items.append((row.i, row.t))
        size += len(row.t)
        if size >= params.block_chars:
            yield from _block(items, params)
            items, size = [], 0
    yield from _block(items, params)


def find(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """(doc_id, item_id, edits) for every item found in every document."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, edits int"
    out = None
    for block in blocks(benchmark, params):
        index = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in text_chunks(batches, limit=1 << 20):
                hits = index.value.find(batch.column("text").to_pylist())
                if hits:
                    text, item, edits = zip(*hits)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(text)), pa.array([index.value.ids[i] for i in item], pa.int64()),
                         pa.array(edits, pa.int32())], ["doc_id", "item_id", "edits"])

        part = whole_text(docs).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams(), text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, in which no item is found."""
    for block in blocks(benchmark, params):
        index = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in text_chunks(batches, text_col, limit=1 << 20):
                hits = index.value.find([t or "" for t in batch.column(text_col).to_pylist()])
                keep = np.ones(batch.num_rows, bool)
                keep[[t for t, _, _ in hits]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
