"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words in lower case. A line is removed if an earlier
line (smaller doc_id, or earlier in the same text) has a Jaccard similarity of
at least `threshold` with it, judged on the input. Lines without a word stay.
`min_tokens` can set a least number of different words; `EVERY`, which the query
and the pipeline take, sets none.

Equal sets form one class, so the join works on classes:

1. words are counted over the whole corpus in a fixed number of hash buckets;
   the order of words by (logarithm of the count, hash) puts rare ones first.
   Buckets with a single word are remembered at a finer grain;
2. two sets that are similar share a word among their rarest
   n - ceil(threshold n) + 1 (prefix filter). Words that nothing else can
   contain, by the counts, are not sent. Postings meet by word, many to a row of
   the shuffle, and pairs pass a length, a positional and a parity filter, all of
   them necessary conditions. Parities of 64 bits say little of sets of over
   `narrow` words, which have 256 more. Sets too small to be similar to any but
   an equal one are not sent at all;
3. the words of the sets that are left are fetched, each from one text that has
   it, and Jaccard is verified;
4. the later class of a similar pair loses its first line, and every class all
   lines but the first.

For each set, the few most alike earlier sets are verified first. A set that
this does not decide is verified against all its candidates in a second round,
so groups of thousands of variants do not send all their pairs, and none is
dropped. Word groups of more than `group_rows` sets are cut into pairs of blocks
that are compared in tasks of their own.

Defined results: a null text is empty; a null doc_id comes first; rows that
repeat an id and a text count as one document and get the same result; lines
that share id and number in different texts are ordered by a hash of their
words, and equal ones by a hash of their texts; extra columns are left behind by `find` and kept by `remove`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contagia.functions.joins import spread_join
from contagia.llm import wordhash
from contagia.llm.common import fresh_name, ragged, release, stash, text_chunks
from contagia.sources.workspace import Workspace

_FIRST = -(2**63)
_SMALL = 256
#: Words of a wide parity.
_WIDE = 4
#: Words that are counted at a time, in two to the power of so many ranges of buckets.
_COUNTED, _RANGES = 1 << 21, 6
#: Postings that are sorted at a time before they are sent.
_SENT = 1 << 18
_SPACE = wordhash.blank_table(b" \t\n\x0b\x0c\r")


@dataclass(frozen=True)
class LineParams:
    #: Similarity as a fraction, so that bounds are exact integers.
    numerator: int = 4
    denominator: int = 5
    min_tokens: int = 5
    #: Bits of the word counts that give the order, and that tell lone words.
    count_bits: int = 18
    lone_bits: int = 24
    #: Bits of the filters that keep unconcerned rows from being sent.
    filter_bits: int = 23
    #: Candidates per word group of which the first round takes the most alike.
    first_round: int = 1
    group_rows: int = 4096
    #: Sets of more words have wide parities.
    narrow: int = 64
    #: Postings that a task holds before it looks for word groups to be cut.
    held_rows: int = 1 << 21


#: No least number of words.
EVERY = LineParams(min_tokens=1)


def _lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all lines, and for each word its text and its line in it."""
    raws = [t.encode().lower() for t in texts]
    raw = np.frombuffer(b"\n".join(raws), np.uint8)
    starts, ends = wordhash.bounds(raw, _SPACE)
    begins = np.cumsum([0, *(len(r) + 1 for r in raws)])[:-1]
    text = np.searchsorted(begins, starts, side="right") - 1
    breaks = np.flatnonzero(raw == 10)
    number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, begins)[text]
    return wordhash.hashes(raw, starts, ends), text, number


def _need(n: np.ndarray, p: LineParams) -> np.ndarray:
    """Least overlap of a set of n words with any similar one."""
    return -(-p.numerator * n // p.denominator)


def _overlap(n: np.ndarray, m: np.ndarray, p: LineParams) -> np.ndarray:
    """Least overlap of two sets of n and m words that are similar."""
    return -(-p.numerator * (n + m) // (p.numerator + p.denominator))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("ord"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _count(p: LineParams):
    """Words per bucket, as a row of arrays for each range of buckets."""
    shift, low = np.uint64(64 - p.lone_bits), p.lone_bits - _RANGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = [], 0
        for batch in text_chunks(batches):
            raw = np.frombuffer(b"\n".join(t.encode().lower() for t in batch.column("text").to_pylist()), np.uint8)
            seen.append((wordhash.hashes(raw, *wordhash.bounds(raw, _SPACE)) >> shift).astype(np.uint32))
            n += len(seen[-1])
            if n >= _COUNTED:
                yield send(seen)
                seen, n = [], 0
        if n:
            yield send(seen)

    def send(seen: list[np.ndarray]) -> pa.RecordBatch:
        bucket, n = np.unique(np.concatenate(seen), return_counts=True)
        part, sizes = np.unique(bucket >> np.uint32(low), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), _blob(bucket, sizes), _blob(n.astype(np.uint32), sizes)], ["part", "bucket", "n"])

    return run


def _summed(p: LineParams):
    """Over these rows, sorted by range: the words in each bucket of the order, and bits of finer buckets that have several."""
    low = p.lone_bits - _RANGES
    fine = 1 << p.lone_bits - p.count_bits

    def out(part: int, count: np.ndarray) -> pa.RecordBatch:
        at = (part << p.count_bits - _RANGES) + np.arange(len(count) // fine)
        top = (part << low) + np.flatnonzero(count > 1)
        one = np.uint64(1) << (top & 63).astype(np.uint64)
        word, first = np.unique(top >> 6, return_index=True)
        bits = np.bitwise_or.reduceat(one, first) if len(first) else one
        return pa.RecordBatch.from_arrays([pa.array(np.append(at, word), pa.int64()), _signed(np.append(count.reshape(-1, fine).sum(axis=1).view(np.uint64), bits)),
                                           pa.array(np.arange(len(at) + len(word)) < len(at))], ["at", "n", "coarse"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = None, None
        for batch in batches:
            for row, k in enumerate(batch.column("part").to_pylist()):
                if k != part:
                    if part is not None:
                        yield out(part, count)
                    part, count = k, np.zeros(1 << low, np.int64)
                bucket, n = (_flat(batch.column(c).slice(row, 1), np.uint32) for c in ("bucket", "n"))
                count[bucket & np.uint32((1 << low) - 1)] += n
        if part is not None:
            yield out(part, count)

    return run


class WordCounts:
    """Words per hash bucket over all documents, as ranks, and which finer buckets have more than one word."""

    def __init__(self, docs: DataFrame, p: LineParams) -> None:
        counted = docs.select("text").mapInArrow(_count(p), "part int, bucket binary, n binary")
        rows = counted.repartition("part").sortWithinPartitions("part").mapInArrow(_summed(p), "at long, n long, coarse boolean").toArrow()  # of fixed size
        coarse, at, n = (rows[c].to_numpy() for c in ("coarse", "at", "n"))
        count = np.zeros(1 << p.count_bits, np.int64)
        count[at[coarse]] = n[coarse]
        self.rank = np.log2(np.maximum(count, 1)).astype(np.uint8)
        self.common = Bits.of(at[~coarse], n[~coarse], p.lone_bits)
        session = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.parts = max(4 * session, int(count.sum()) >> 20)  # so that a part is small, however large the corpus


class Sets:
    """The lines of some texts as sets, in the order of rarity, or of hashes without counts."""

    def __init__(self, texts: list[str], counts: WordCounts | None, p: LineParams) -> None:
        h, text, number = _lines(texts)
        rank = counts.rank[(h >> np.uint64(64 - p.count_bits)).astype(np.int64)] if counts else 0
        new = np.ones(len(h), bool)
        new[1:] = (text[1:] != text[:-1]) | (number[1:] != number[:-1])
        line = np.cumsum(new) - 1
        shift = 64 - 6 - int(new.sum()).bit_length()
        if shift >= 40:  # one sort by line, rank and 40 bits or more of the hash
            by = np.argsort((line * 64 + rank).astype(np.uint64) << np.uint64(shift) | h >> np.uint64(64 - shift))
        else:
            by = np.lexsort((h, line * 64 + rank))
        h, line = h[by], line[by]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        h, line = h[once], line[once]
        sizes = np.bincount(line, minlength=int(new.sum()))
        enough = sizes >= p.min_tokens
        keep = enough[line]
        self.h = h[keep]
        self.size = sizes[enough]
        self.text, self.number = text[new][enough], number[new][enough]
        self.first = np.cumsum(self.size) - self.size
        self.place = np.arange(len(self.h)) - np.repeat(self.first, self.size)
        if len(self.size):
            mixed = (self.h ^ (self.h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            self.set_hash = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), self.first)
            self.parity = np.bitwise_xor.reduceat(np.uint64(1) << (self.h & np.uint64(63)), self.first)
        else:
            self.set_hash = self.parity = np.zeros(0, np.uint64)

    def wide(self, which: np.ndarray) -> np.ndarray:
        """The wide parities of some sets, one after another."""
        out = np.zeros((int(which.sum()), _WIDE), np.uint64)
        if len(out):
            h = self.h[np.repeat(which, self.size)]
            first = np.cumsum(self.size[which]) - self.size[which]
            bit = np.uint64(1) << (h >> np.uint64(8) & np.uint64(63))
            for w in range(_WIDE):
                out[:, w] = np.bitwise_xor.reduceat(np.where(h >> np.uint64(6) & np.uint64(3) == np.uint64(w), bit, np.uint64(0)), first)
        return out.reshape(-1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _blob(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column of the values of all rows, by the number of values of each: Spark moves it without looking at them."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths * values.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _ends(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]


def _flat(column: pa.Array, kind: type) -> np.ndarray:
    """The values of all rows of such a column."""
    if not len(column):
        return np.zeros(0, kind)
    ends = _ends(column)
    data = column.buffers()[2]
    return np.frombuffer(data[int(ends[0]):int(ends[-1])] if data else b"", np.uint8).view(kind)


def _lengths(column: pa.Array, kind: type) -> np.ndarray:
    return np.diff(_ends(column)) // np.dtype(kind).itemsize if len(column) else np.zeros(0, np.int64)


def _line_rows(counts, p: LineParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            s = Sets(batch.column("text").to_pylist(), counts.value, p)
            lead = np.zeros(len(s.size), bool)  # equal sets of a chunk send their words once, with the first line
            order = np.lexsort((s.number, batch.column("ord").to_numpy(zero_copy_only=False)[s.text]))
            lead[order[np.unique(np.stack([s.set_hash, s.parity])[:, order], axis=1, return_index=True)[1]]] = True
            lead &= _need(s.size + 1, p) <= s.size  # others are similar to equal sets only, which are one class
            prefix = np.repeat(lead, s.size) & (s.place < np.repeat(s.size - _need(s.size, p) + 1, s.size))
            prefix[prefix] = counts.value.common.has(s.h[prefix])
            row = np.repeat(np.arange(len(s.size)), s.size)[prefix]
            n = np.bincount(row, minlength=len(s.size))
            wide = (n > 0) & (s.size > p.narrow)
            order, key = (batch.column(c).take(pa.array(s.text)) for c in ("ord", "text_key"))
            yield pa.RecordBatch.from_arrays(
                [order, key, pa.array(s.number, pa.int32()), pa.array(s.size, pa.int32()), _signed(s.set_hash), _signed(s.parity),
                 _blob((s.h[prefix] >> np.uint64(32)).astype(np.uint32), n), _blob(s.place[prefix].astype(np.int32), n),
                 _blob(s.wide(wide), _WIDE * wide)],
                ["ord", "text_key", "line", "n", "h", "parity", "words", "places", "wide"])
    return run


_LINES = "ord long, text_key long, line int, n int, h long, parity long, words binary, places binary, wide binary"
_TYPES = {"key": np.int32, "n": np.int32, "place": np.int32, "h": np.int64, "parity": np.int64, "ord": np.int64, "line": np.int32, "asked": bool}


def _postings(batch: pa.RecordBatch, p: LineParams) -> dict[str, np.ndarray]:
    """One posting for every word that a line sends; wide parities of those of more than `narrow` words follow each other."""
    rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "h", "parity", "ord", "line", "asked")}
    line = np.repeat(np.arange(batch.num_rows), _lengths(batch.column("words"), np.int32))
    wide = _flat(batch.column("wide"), np.int64).reshape(-1, _WIDE)
    at = np.cumsum(_lengths(batch.column("wide"), np.int64) > 0) - 1
    g = {c: v[line] for c, v in rows.items()}
    return g | {"key": _flat(batch.column("words"), np.int32), "place": _flat(batch.column("places"), np.int32),
                "wide": wide[at[line[g["n"] > p.narrow]]]}


def _cells(batch: pa.RecordBatch, p: LineParams) -> dict[str, np.ndarray]:
    """The same from postings that are rows."""
    g = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(t) for c, t in _TYPES.items()}
    return g | {"wide": _flat(batch.column("wide"), np.int64).reshape(-1, _WIDE)}


def _joined(gs: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return gs[0] if len(gs) == 1 else {c: np.concatenate([g[c] for g in gs]) for c in gs[0]}


def _pick(g: dict[str, np.ndarray], rows: np.ndarray, p: LineParams) -> dict[str, np.ndarray]:
    """Some postings, by their numbers, with their wide parities."""
    big = g["n"] > p.narrow
    at = np.cumsum(big) - 1
    return {c: v[at[rows[big[rows]]]] if c == "wide" else v[rows] for c, v in g.items()}


def _packed(read, parts: int, p: LineParams):
    """Postings by parts of the words: a row for each part of `_SENT` postings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(read(batch, p))
            n += len(held[-1]["key"])
            if n >= _SENT:
                yield send(held)
                held, n = [], 0
        if n:
            yield send(held)

    def send(gs: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        g = _joined(gs)
        part = (g["key"].view(np.uint32) % np.uint32(parts)).astype(np.int32)
        by = np.argsort(part, kind="stable")
        g, part = _pick(g, by, p), part[by]
        own, n = np.unique(part, return_counts=True)
        wide = _WIDE * np.add.reduceat(g["n"] > p.narrow, np.cumsum(n) - n, dtype=np.int64)
        columns = [_blob(g[c].astype(t, copy=False), n) for c, t in _TYPES.items()]
        return pa.RecordBatch.from_arrays([pa.array(own), *columns, _blob(g["wide"].reshape(-1), wide)], ["part", *_TYPES, "wide"])

    return run


_PACKED = ", ".join(["part int", *(f"{c} binary" for c in (*_TYPES, "wide"))])


def _compare(i: np.ndarray, j: np.ndarray, g: dict[str, np.ndarray], p: LineParams) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs of rows i and j of a word group that may be similar, and how far their parities differ."""
    # What is left of both from the word on must reach the least overlap; that implies that their sizes are near enough.
    ok = np.flatnonzero((g["left"][i] >= g["size"][j]) & (g["left"][j] >= g["size"][i]))
    i, j = i[ok], j[ok]
    n, m = g["n"][i], g["n"][j]
    most = n + m - 2 * _overlap(n, m, p)
    apart = np.bitwise_count(g["parity"][i] ^ g["parity"][j]).astype(np.int32)
    fits = (apart <= most) & ((g["h"][i] != g["h"][j]) | (g["parity"][i] != g["parity"][j]))
    ok, i, j, most, apart = (x[fits] for x in (ok, i, j, most, apart))
    wide = np.flatnonzero((g["at"][i] >= 0) & (g["at"][j] >= 0))
    apart[wide] = np.bitwise_count(g["wide"][g["at"][i[wide]]] ^ g["wide"][g["at"][j[wide]]]).sum(axis=1)
    fits = apart <= most
    return ok[fits], apart[fits]


def _group_pairs(p: LineParams, most: int | None, limit: int | None):
    """Over packed postings sorted by part: candidate pairs (later, earlier).

    `most` is the number of pairs per later set and group, the most alike first;
    such a set is marked if it has more. Groups over `limit` rows go out as
    they are, to be cut in blocks.
    """
    def ordered(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Sorted by word and order, without the later lines of a class in a group."""
        by = np.lexsort((g["line"], g["ord"], g["key"]))
        tied = np.logical_and.reduce([g[c][by[1:]] == g[c][by[:-1]] for c in ("key", "ord", "line")])
        if tied.any():
            by = np.lexsort((g["parity"], g["h"], g["line"], g["ord"], g["key"]))
        # Rows of the same word and class follow each other in `at`, in this order.
        key, h, parity = (g[c][by] for c in ("key", "h", "parity"))
        at = np.argsort(h ^ (key.astype(np.int64) << 32), kind="stable")
        same = np.zeros(len(by), bool)
        same[at[1:]] = np.logical_and.reduce([x[at[1:]] == x[at[:-1]] for x in (key, h, parity)])
        return _pick(g, by[~same], p)

    def pairs(g: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        big = g["n"] > p.narrow
        g = g | {c: g[c].view(np.uint64) for c in ("h", "parity", "wide")} | {"at": np.where(big, np.cumsum(big) - 1, -1)}
        n = g["n"].astype(np.int64)
        g |= {"size": p.numerator * n, "left": (p.numerator + p.denominator) * (n - g["place"]) - p.numerator * n}
        cut = np.flatnonzero(g["key"][1:] != g["key"][:-1]) + 1
        starts, stops = np.append(0, cut), np.append(cut, len(g["key"]))
        sizes = stops - starts
        run = np.repeat(np.arange(len(starts)), sizes)
        later, earlier, apart = [], [], []
        j = np.flatnonzero(sizes[run] <= _SMALL)
        for gap in range(1, _SMALL):
            j = j[:np.searchsorted(j, len(run) - gap)]
            j = j[run[j + gap] == run[j]]
            if not len(j):
                break
            b = j[g["asked"][j + gap]]
            ok, d = _compare(b + gap, b, g, p)
            later.append(b[ok] + gap)
            earlier.append(b[ok])
            apart.append(d)
        for k in np.flatnonzero(sizes > _SMALL):
            rows = np.arange(starts[k], stops[k])
            for at in range(1, len(rows), 256):
                i = rows[at:at + 256]
                i = i[g["asked"][i]]
                if len(i):
                    a, b = np.repeat(i, len(rows)), np.tile(rows, len(i))
                    near = b < a
                    a, b = a[near], b[near]
                    ok, d = _compare(a, b, g, p)
                    later.append(a[ok])
                    earlier.append(b[ok])
                    apart.append(d)
        if not later:
            return
        later, earlier, apart = (np.concatenate(x) for x in (later, earlier, apart))
        by = np.lexsort((earlier, apart, later))
        later, earlier, apart = later[by], earlier[by], apart[by]
        first = np.ones(len(later), bool)
        first[1:] = later[1:] != later[:-1]
        turn = np.arange(len(later)) - np.maximum.accumulate(np.where(first, np.arange(len(later)), 0))
        more = np.zeros(len(later), bool)
        if most is not None:
            over = later[turn == most]
            keep = turn < most
            later, earlier, apart, more = later[keep], earlier[keep], apart[keep], np.isin(later[keep], over)
        if len(later):
            yield pa.RecordBatch.from_arrays(
                [_signed(g["h"][later]), _signed(g["parity"][later]), _signed(g["h"][earlier]), _signed(g["parity"][earlier]), pa.array(more),
                 pa.array(apart, pa.int32()), *(pa.nulls(len(later), t) for t in (pa.int32(),) * 3), pa.nulls(len(later), pa.int64()),
                 pa.nulls(len(later), pa.int32()), pa.nulls(len(later), pa.binary())], _FOUND)

    def whole(g: dict[str, np.ndarray]) -> pa.RecordBatch:
        none, n = pa.nulls(len(g["key"]), pa.int64()), _WIDE * (g["n"] > p.narrow)
        return pa.RecordBatch.from_arrays(
            [pa.array(g["h"]), pa.array(g["parity"]), none, none, pa.array(g["asked"]), pa.nulls(len(n), pa.int32()), pa.array(g["key"]),
             pa.array(g["n"]), pa.array(g["place"]), pa.array(g["ord"]), pa.array(g["line"]), _blob(g["wide"].reshape(-1), n)], _FOUND)

    def cut(g: dict[str, np.ndarray], large: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        out = np.isin(g["key"], large)
        return _pick(g, np.flatnonzero(~out), p), _pick(g, np.flatnonzero(out), p)

    def rows_over(g: dict[str, np.ndarray]) -> np.ndarray:
        """Words of too many lines, of sorted postings."""
        if limit is None or not len(g["key"]):
            return g["key"][:0]
        edges = np.concatenate([[0], np.flatnonzero(g["key"][1:] != g["key"][:-1]) + 1, [len(g["key"])]])
        return g["key"][edges[:-1]][np.diff(edges) > limit]

    def finish(gs: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not gs:
            return
        g = ordered(_joined(gs))
        if len(over := rows_over(g)):
            g, out = cut(g, over)
            yield whole(out)
        if len(g["key"]) > 1:
            yield from pairs(g)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n, bound, large = None, [], 0, p.held_rows, np.zeros(0, np.int32)
        for batch in batches:
            parts = batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1), len(parts)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if lo == hi:
                    continue
                if parts[lo] != part:
                    yield from finish(held)
                    part, held, n, bound, large = parts[lo], [], 0, p.held_rows, large[:0]
                own = batch.slice(lo, hi - lo)
                g = {c: _flat(own.column(c), t) for c, t in _TYPES.items()}
                g["wide"] = _flat(own.column("wide"), np.int64).reshape(-1, _WIDE)
                if len(large):
                    g, out = cut(g, large)
                    if len(out["key"]):
                        yield whole(out)
                held.append(g)
                n += len(g["key"])
                if limit is not None and n > bound:  # a word of very many lines is not held any longer
                    g = ordered(_joined(held))
                    large = np.union1d(large, rows_over(g))
                    g, out = cut(g, large)
                    if len(out["key"]):
                        yield whole(out)
                    held, n = [g], len(g["key"])
                    bound = max(p.held_rows, 2 * n)
        yield from finish(held)

    return run


_PAIRS = "h long, parity long, h2 long, parity2 long, more boolean, apart int, key int, n int, place int, ord long, line int, wide binary"
_FOUND = [c.split()[0] for c in _PAIRS.split(", ")]


def _meet(lines: DataFrame, counts, p: LineParams, most: int | None, workspace: Workspace, name: str) -> DataFrame:
    """Candidate pairs of all lines (with `asked`) that send the same word:
    all of them, or, with `most`, one per later set, marked where it has more.

    Keys are halves of word hashes; words that share one only meet in vain."""
    def grouped(frame: DataFrame, read, limit: int | None) -> DataFrame:
        packed = frame.mapInArrow(_packed(read, counts.value.parts, p), _PACKED)
        return packed.repartition("part").sortWithinPartitions("part").mapInArrow(_group_pairs(p, most, limit), _PAIRS)

    found = stash(grouped(lines, _postings, p.group_rows), workspace, name)
    large = found.where("h2 IS NULL").groupBy("key", "h", "parity", "n", "place").agg(
        F.min(F.struct("ord", "line")).alias("f"), F.max("more").alias("asked"), F.first("wide").alias("wide")).select(
        "key", "n", "place", "h", "parity", "f.*", "asked", "wide")
    sizes = large.groupBy("key").agg(F.ceil(F.count("*") / F.lit(p.group_rows)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")
    cells = (spread_join(large, sizes, ["key"], ["h"], spread=8).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("key", F.hash("key", F.least("own", "other"), F.greatest("own", "other"))).drop("blocks", "own", "other"))
    pairs = found.where("h2 IS NOT NULL")
    if not found.where("h2 IS NULL").isEmpty():
        pairs = pairs.unionByName(grouped(cells, _cells, None))
    if most is None:
        return pairs.select("h", "parity", "h2", "parity2").distinct()
    # Of the pairs from different words, again the most alike.
    other = F.struct("h2", "parity2")
    return pairs.groupBy("h", "parity").agg(
        F.min(F.struct("apart", "h2", "parity2")).alias("best"), (F.max("more") | (F.min(other) != F.max(other))).alias("more")
    ).select("h", "parity", "best.h2", "best.parity2", "more")


class Bits:
    """A fixed-size filter of 64-bit keys; members always pass."""

    def __init__(self, keys: DataFrame, key: Column, bits: int) -> None:
        self.bits = bits
        top = F.shiftrightunsigned(key, 64 - bits)
        rows = keys.select(F.shiftrightunsigned(top, 6).alias("at"), F.expr("1L").alias("one"), top.alias("top")).select(
            "at", F.expr("shiftleft(one, cast(top & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("word")).toArrow()
        self._fill(rows["at"].to_numpy(), rows["word"].to_numpy())

    @classmethod
    def of(cls, at: np.ndarray, words: np.ndarray, bits: int) -> Bits:
        out = cls.__new__(cls)
        out.bits = bits
        out._fill(at, words)
        return out

    def _fill(self, at: np.ndarray, words: np.ndarray) -> None:
        self.words = np.zeros(1 << max(self.bits - 6, 0), np.int64)
        np.bitwise_or.at(self.words, at, words)

    def has(self, keys: np.ndarray) -> np.ndarray:
        top = keys.view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.words.view(np.uint64)[(top >> np.uint64(6)).astype(np.int64)] >> (top & np.uint64(63))) & np.uint64(1) > 0


def _passes(keys: DataFrame, key: Column, p: LineParams):
    """A function of a column that is true at least for the keys."""
    bits = keys.sparkSession.sparkContext.broadcast(Bits(keys, key, p.filter_bits))

    @F.pandas_udf("boolean")
    def passes(column: pd.Series) -> pd.Series:
        return pd.Series(bits.value.has(column.to_numpy(np.int64)))

    return passes


def _undecided_lines(lines: DataFrame, undecided: DataFrame, p: LineParams) -> DataFrame:
    """The lines with those words only that an undecided set sends as well, as only they can bring further pairs.

    Filters of fixed size choose them; what passes in vain is verified in vain."""
    context, sent = lines.sparkSession.sparkContext, lines.where(F.length("words") > 0)
    sets = context.broadcast(Bits(undecided, F.col("h"), p.filter_bits))

    def of_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _flat(batch.filter(pa.array(sets.value.has(batch.column("h").to_numpy()))).column("words"), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(words).astype(np.int64))], ["key"])

    keys = context.broadcast(Bits(sent.select("h", "words").mapInArrow(of_sets, "key long"), F.shiftleft("key", 32), p.filter_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = sets.value.has(batch.column("h").to_numpy())
            words, places = (_flat(batch.column(c), np.int32) for c in ("words", "places"))
            line = np.repeat(np.arange(batch.num_rows), _lengths(batch.column("words"), np.int32))
            met = keys.value.has(words.astype(np.int64) << 32)
            n = np.bincount(line[met], minlength=batch.num_rows)
            own = {"words": _blob(words[met], n), "places": _blob(places[met], n), "asked": pa.array(asked)}
            names = [*batch.schema.names, "asked"]
            yield pa.RecordBatch.from_arrays([own[c] if c in own else batch.column(c) for c in names], names).filter(pa.array(n > 0))

    return sent.mapInArrow(run, f"{_LINES}, asked boolean")


def _similar(keyed: DataFrame, lines: DataFrame, pairs: DataFrame, p: LineParams) -> DataFrame:
    """(h, parity) of the later sets of pairs whose Jaccard similarity reaches the threshold.

    Of the texts that have a set, the one of the least key gives its words. Both sides find their words in one shuffled table of sets, and only those of the earlier side travel on, to the later one."""
    later, earlier = F.struct("h", "parity"), F.struct(F.col("h2").alias("h"), F.col("parity2").alias("parity"))
    concerned = pairs.select(F.explode(F.array(later, earlier)).alias("side")).select("side.*")
    context = keyed.sparkSession.sparkContext
    bits = context.broadcast(Bits(concerned, F.col("h"), p.filter_bits))

    def in_question(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bits.value.has(batch.column("h").to_numpy())))

    holders = lines.select("h", "parity", "text_key").mapInArrow(in_question, "h long, parity long, text_key long")
    holders = holders.groupBy("h", "parity").agg(F.min("text_key").alias("text_key"))
    texts = context.broadcast(Bits(holders, F.col("text_key"), p.filter_bits))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(texts.value.has(batch.column("text_key").to_numpy())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(held(batches)):
            s = Sets(batch.column("text").to_pylist(), None, p)
            rows = np.flatnonzero(bits.value.has(s.set_hash))
            rows = rows[np.unique(np.stack([s.set_hash[rows], s.parity[rows]]), axis=1, return_index=True)[1]]
            if len(rows):
                flat = np.concatenate([s.h[s.first[r]:s.first[r] + s.size[r]] for r in rows])
                yield pa.RecordBatch.from_arrays([_signed(s.set_hash[rows]), _signed(s.parity[rows]), ragged(flat.view(np.int64), s.size[rows], pa.int64())],
                                                 ["h", "parity", "words"])

    sets = keyed.select("text_key", "text").mapInArrow(run, "h long, parity long, words array<long>").groupBy("h", "parity").agg(F.first("words").alias("words"))
    others = sets.select(F.col("h").alias("h2"), F.col("parity").alias("parity2"), F.col("words").alias("words2"))
    met = pairs.select("h", "parity", "h2", "parity2").join(others, ["h2", "parity2"]).select("h", "parity", "words2").join(sets, ["h", "parity"])
    shared = F.size(F.array_intersect("words", "words2"))
    union = F.size("words") + F.size("words2") - shared
    return met.where(shared * p.denominator >= union * p.numerator).select("h", "parity").distinct()


def find(docs: DataFrame, workspace: Workspace, p: LineParams = LineParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(ord, text_key, lines): numbers of the lines to remove from each document that has any."""
    keyed = _keyed(docs, id_col, text_col)
    counts = docs.sparkSession.sparkContext.broadcast(WordCounts(keyed, p))
    lines = stash(keyed.mapInArrow(_line_rows(counts, p), _LINES), workspace, "lines")
    spark = docs.sparkSession
    first = stash(_meet(lines.where(F.length("words") > 0).withColumn("asked", F.lit(True)), counts, p, p.first_round, workspace, "met"), workspace, "pairs")
    release(spark)
    gone = stash(_similar(keyed, lines, first, p), workspace, "gone")
    release(spark)

    # Sets with more candidates than were tried, and not decided yet.
    undecided = stash(first.where("more").select("h", "parity").distinct().join(gone, ["h", "parity"], "left_anti"), workspace, "undecided")
    if not undecided.isEmpty():
        again = _undecided_lines(lines, undecided, p)
        rest = stash(_meet(again, counts, p, None, workspace, "met2").join(first, ["h", "parity", "h2", "parity2"], "left_anti"), workspace, "pairs2")
        release(spark)
        gone = stash(gone.union(_similar(keyed, lines, rest, p)).distinct(), workspace, "gone2")
        release(spark)

    # Sets of a single line that is not gone take no further part, but for what passes a filter in vain.
    touched = lines.groupBy("h").count().where("count > 1").select("h").union(gone.select("h"))
    lines = lines.select("ord", "text_key", "line", "h", "parity").where(_passes(touched, F.col("h"), p)("h"))
    classes = lines.groupBy("h", "parity").agg(F.min(F.struct("ord", "line", "text_key")).alias("f")).select("h", "parity", "f.*")
    marked = classes.select("h", "parity", *(F.col(c).alias(f"{c}1") for c in ("ord", "line", "text_key"))).join(
        gone.withColumn("gone", F.lit(True)), ["h", "parity"], "left")
    hit = spread_join(lines, marked, ["h", "parity"], ["ord", "line"], spread=8)
    later = (F.col("ord") != F.col("ord1")) | (F.col("line") != F.col("line1")) | (F.col("text_key") != F.col("text_key1")) | F.coalesce("gone", F.lit(False))
    return hit.where(later).groupBy("ord", "text_key").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def remove(docs: DataFrame, workspace: Workspace, p: LineParams = LineParams(), id_col: str = "doc_id", text_col: str = "text",
           removed_col: str = "_removed") -> DataFrame:
    """The rows with their lines removed from the text, and the numbers of these lines in `removed_col`, which must be a new name.

    Rows without a removed line pass a filter of fixed size and are not shuffled."""
    found = stash(find(docs, workspace, p, id_col, text_col), workspace, "found")
    release(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    order, key, asked_, gone = (fresh_name(docs, c) for c in ("ord", "key", "asked", "gone"))
    keyed = docs.withColumns({order: F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)), key: F.xxhash64(text)})
    asked = keyed.withColumn(asked_, _passes(found, F.col("text_key"), p)(key))
    lines = found.select(F.col("ord").alias(order), F.col("text_key").alias(key), F.col("lines").alias(gone))
    joined = asked.where(F.col(asked_)).join(lines, [order, key], "left").select(*docs.columns, gone)
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda _, i: ~F.array_contains(gone, i)), "\n")
    cut = joined.withColumn(text_col, F.when(F.col(gone).isNotNull(), kept).otherwise(F.col(text_col)))
    plain = asked.where(~F.col(asked_)).select(*docs.columns, F.lit(None).cast("array<int>").alias(gone))
    return cut.unionByName(plain).withColumnRenamed(gone, removed_col)


def report(docs: DataFrame, workspace: Workspace, p: LineParams = LineParams()) -> DataFrame:
    """One row per document: its lines, how many were removed, and a digest of what is left."""
    result = remove(docs.select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines")), workspace, p)
    return result.select("doc_id", "n_lines", F.coalesce(F.size("_removed"), F.lit(0)).cast("long").alias("n_removed"),
                         F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
