"""Alignment of the tokens of two tokenizers over the same bytes.

All documents of a batch are merged in lockstep: one state vector holds the
next A and the next B token of every document, and each step links the two,
cuts where both end, moves on the one that ends first (or both), and drops
finished documents from the vector. Long documents enter as several stretches
between places where both tokenizers end a token, so a batch takes as many
steps as its longest stretch and not as its longest document.

How often an A and a B id are linked over the corpus is counted per dictionary
of a task first. Documents are stored as numbers into that dictionary, so only
one row per pair and dictionary is shuffled, and the counts travel back the
same way.

Defined results: texts that are null or empty, or whose joined tokens are not
the bytes of a space and the text, have no tokens; repeated rows and null ids
are documents of their own; columns other than the id and the text are left
behind; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contagia.llm.common import ragged, stash, text_chunks, whole_text
from contagia.llm.sentencepiece_codec import Codec
from contagia.llm.wordcache import flat
from contagia.sources.workspace import Workspace

#: Pairs of one dictionary; it is closed when it holds that many.
DICTIONARY_PAIRS = 1 << 19
#: A tokens of a stretch of a long document.
STRETCH = 512
#: What the byte-level tokenizer takes as one piece, as the published vocabulary defines it (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_B_BITS = 32
_B_MASK = (1 << _B_BITS) - 1


class Surfaces:
    """Bytes of every token id of a vocabulary."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.size = np.array([len(p) for p in pieces], np.int64)
        self._at = np.cumsum(self.size) - self.size
        self._bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self._bytes[np.repeat(self._at[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class ByteLevel:
    """Ids of a byte-level vocabulary; strings of special tokens are plain text."""

    def __init__(self, definition: str) -> None:
        model = json.loads(definition)["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = (b for b in range(256) if b not in set(shown))
        back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {bytes(map(back.__getitem__, piece)): i for piece, i in model["vocab"].items() if all(c in back for c in piece)}
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            pieces[i] = piece
        self.surfaces = Surfaces(pieces)
        self._encode = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat([self._encode(" " + t) for t in texts])


class Pieces:
    """Ids of a piece model, which puts a space before the text itself."""

    def __init__(self, model: bytes) -> None:
        self._codec = Codec.of(model)
        p = self._codec.processor
        names = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.surfaces = Surfaces([bytes([int(s[3:-1], 16)]) if p.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(names)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._codec.encode(texts)


@dataclass
class Batch:
    """Aligned tokens of some documents, one after the other; those without tokens have a count of zero."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


def _stretches(ends_a: np.ndarray, ends_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, stretch: int) -> tuple[np.ndarray, ...]:
    """First A token, first B token and A end of every stretch: documents, cut where both end a token."""
    stop = np.cumsum(n_a)
    start = stop - n_a
    pieces = -(-n_a // stretch)
    doc = np.repeat(np.arange(len(n_a)), pieces)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    a = start[doc] + k * stretch  # the token before which a cut is wanted
    found = k == 0
    first_b = (np.cumsum(n_b) - n_b)[doc]
    for _ in range(min(16, stretch)):  # look a few tokens further for a common end
        open_ = np.flatnonzero(~found & (a < stop[doc]))
        if not len(open_):
            break
        end = ends_a[a[open_] - 1]
        j = np.searchsorted(ends_b, end)
        hit = ends_b[j] == end
        first_b[open_[hit]] = j[hit] + 1
        found[open_[hit]] = True
        a[open_[~hit]] += 1
    a, b, doc = a[found], first_b[found], doc[found]
    return a, b, np.where(np.append(doc[1:] == doc[:-1], False), np.append(a[1:], 0), stop[doc])


def merge(ends_a: np.ndarray, ends_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, ...]:
    """Links (A token, B token) in order, and the tokens that end at cuts.

    `ends` are byte offsets in all documents joined; documents cover the same bytes in both."""
    i, j, stop = (x.astype(np.int32) for x in _stretches(ends_a, ends_b, n_a, n_b, stretch))
    links, cuts = [], []
    while len(i):
        x, y = ends_a[i], ends_b[j]
        links.append((i, j))
        same = np.flatnonzero(x == y)
        cuts.append((i[same], j[same]))
        i, j = i + (x <= y), j + (y <= x)
        live = i < stop
        if not live.all():
            i, j, stop = i[live], j[live], stop[live]
    none = np.zeros(0, np.int32)
    link_a, link_b = (np.concatenate([none, *(x[k] for x in links)]) for k in (0, 1))
    cut_a, cut_b = (np.sort(np.concatenate([none, *(x[k] for x in cuts)])) for k in (0, 1))
    slot = np.full(len(ends_a) + len(ends_b), -1, np.int32)  # a + b grows along every path
    slot[link_a + link_b] = link_a
    filled = np.flatnonzero(slot >= 0)
    return slot[filled], (filled - slot[filled]).astype(np.int32), cut_a, cut_b


class Aligner:
    """Two tokenizers; one per Python worker."""

    _open: dict[tuple[str, bytes], Aligner] = {}

    def __init__(self, definition: str, model: bytes) -> None:
        self.a, self.b = ByteLevel(definition), Pieces(model)
        self._strings = np.array([f"{i}{s}" for s in ",|" for i in range(len(self.a.surfaces.size))]
                                 + [f"{i}{s}" for s in ",;" for i in range(len(self.b.surfaces.size))], object)

    @classmethod
    def of(cls, definition: str, model: bytes) -> Aligner:
        if (definition, model) not in cls._open:
            cls._open[definition, model] = cls(definition, model)
        return cls._open[definition, model]

    def align(self, texts: list[str]) -> Batch:
        raws = [b" " + t.encode() if t else b"" for t in texts]
        size = np.array([len(r) for r in raws], np.int64)
        sides = []
        for side in (self.a, self.b):
            ids, n = side.encode(texts)
            width = side.surfaces.size[ids]
            doc = np.repeat(np.arange(len(texts)), n)
            good = (np.bincount(doc, width, len(texts)) == size) & (size > 0)
            sides.append((side, ids, n, doc, good))
        good = sides[0][4] & sides[1][4]
        for side, ids, n, doc, _ in sides:  # of one length as the text: compare byte by byte
            own = np.frombuffer(b"".join(r for r, g in zip(raws, good) if g), np.uint8)
            wrong = np.flatnonzero(side.surfaces.joined(ids[good[doc]]) != own)
            if len(wrong):
                kept = np.flatnonzero(good)
                good = good.copy()
                good[kept[np.searchsorted(np.cumsum(size[kept]), wrong, side="right")]] = False
        out = []
        for side, ids, n, doc, _ in sides:
            ids = ids[good[doc]]
            out += [ids, np.where(good, n, 0), np.cumsum(side.surfaces.size[ids])]
        ids_a, n_a, ends_a, ids_b, n_b, ends_b = out
        return Batch(ids_a, ids_b, n_a, n_b, ends_a, ends_b, *merge(ends_a, ends_b, n_a, n_b))

    def groups(self, batch: Batch) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of every document."""
        n, m = len(batch.ids_a), len(batch.ids_b)
        last_a, last_b = np.zeros(n, bool), np.zeros(m, bool)
        last_a[batch.cut_a] = last_b[batch.cut_b] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        codes = np.empty(n + m, np.int64)
        codes[np.arange(n) + np.concatenate([[0], batch.cut_b + 1])[group_a]] = batch.ids_a + last_a * len(self.a.surfaces.size)
        offset = 2 * len(self.a.surfaces.size)
        codes[np.arange(m) + np.append(batch.cut_a + 1, 0)[group_b]] = offset + batch.ids_b + last_b * len(self.b.surfaces.size)
        stops = np.cumsum(batch.n_a + batch.n_b)
        parts = self._strings[codes]
        return ["".join(parts[hi - k:hi])[:-1] for hi, k in zip(stops, batch.n_a + batch.n_b)]


class Dictionary:
    """Numbers for id pairs in the order they are met, and how often each was linked."""

    def __init__(self) -> None:
        self.pairs = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self._index = pd.Index(self.pairs)

    def numbers(self, pairs: np.ndarray) -> np.ndarray:
        codes, distinct = pd.factorize(pairs)
        known = self._index.get_indexer(distinct)
        new = known < 0
        known[new] = len(self.pairs) + np.arange(new.sum())
        if new.any():
            self.pairs = np.concatenate([self.pairs, distinct[new]])
            self._index = pd.Index(self.pairs)
            self.counts = np.concatenate([self.counts, np.zeros(new.sum(), np.int64)])
        self.counts[known] += np.bincount(codes, minlength=len(distinct))
        return known[codes]


def pack(numbers: np.ndarray) -> bytes:
    """Sorted distinct numbers by their gaps, and how often each occurs, as planes of bytes."""
    distinct, n = np.unique(numbers, return_counts=True)
    gaps = np.diff(distinct, prepend=0).astype("<u4")
    wide = n >= 255
    planes = gaps.view(np.uint8).reshape(-1, 4).T[:3]
    return b"".join([len(gaps).to_bytes(4, "little"), planes.tobytes(), np.where(wide, 255, n).astype(np.uint8).tobytes(), n[wide].astype("<u4").tobytes()])


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(blob[:4], "little")
    raw = np.frombuffer(blob, np.uint8, 4 * size, 4)
    planes = raw[:3 * size].reshape(3, size).astype(np.int64)
    n = raw[3 * size:].astype(np.int64)
    n[n == 255] = np.frombuffer(blob, "<u4", offset=4 + 4 * size)
    return np.cumsum(planes[0] | planes[1] << 8 | planes[2] << 16), n


def _aligner(docs: DataFrame, a_path: str, b_path: str):
    context = docs.sparkSession.sparkContext
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:  # small files beside the program, not data
        shared = context.broadcast((a.read(), b.read()))
    return lambda: Aligner.of(*shared.value)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, ids_a, ids_b, link_a, link_b, cuts): ids, positions of linked
    tokens, and byte offsets (in space and text) where tokens of both end."""
    aligner = _aligner(docs, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            b = aligner().align(chunk.column("text").to_pylist())
            docs_ = len(b.n_a)
            doc_a = np.repeat(np.arange(docs_), b.n_a)
            first_a, first_b = np.cumsum(b.n_a) - b.n_a, np.cumsum(b.n_b) - b.n_b
            of_link, of_cut = doc_a[b.link_a], doc_a[b.cut_a]
            before = np.append(0, b.ends_a)[first_a] if len(b.ends_a) else np.zeros(docs_, np.int64)
            lists = [(b.ids_a, b.n_a), (b.ids_b, b.n_b), (b.link_a - first_a[of_link], np.bincount(of_link, minlength=docs_)),
                     (b.link_b - first_b[of_link], np.bincount(of_link, minlength=docs_)),
                     (b.ends_a[b.cut_a] - before[of_cut], np.bincount(of_cut, minlength=docs_))]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *(ragged(x, n, pa.int32()) for x, n in lists)],
                                             ["doc_id", "ids_a", "ids_b", "link_a", "link_b", "cuts"])

    return whole_text(docs).mapInArrow(run, "doc_id long, ids_a array<int>, ids_b array<int>, link_a array<int>, link_b array<int>, cuts array<int>")


_ROW = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                  ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary()),
                  ("number", pa.int32()), ("pair", pa.int64()), ("n", pa.int64())])
_ROW_SQL = ("chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, "
            "number int, pair long, n long")


def _batch(schema: pa.Schema, rows: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema],
                                      schema=schema)


def _measure(docs: DataFrame, a_path: str, b_path: str, most_pairs: int) -> DataFrame:
    """One row per document (`links` is set) and one per pair of every dictionary (`pair` is set)."""
    aligner = _aligner(docs, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known = TaskContext.get().partitionId(), Dictionary()
        chunks = count(part << 32)
        chunk = next(chunks)
        for batch in text_chunks(batches):
            if len(known.pairs) >= most_pairs:
                yield from pairs_of(chunk, known)
                known, chunk = Dictionary(), next(chunks)
            own = aligner()
            b = own.align(batch.column("text").to_pylist())
            n = len(b.n_a)
            doc_a = np.repeat(np.arange(n), b.n_a)
            links = np.bincount(doc_a[b.link_a], minlength=n)
            numbers = np.split(known.numbers(b.ids_a[b.link_a].astype(np.int64) << _B_BITS | b.ids_b[b.link_b]), np.cumsum(links)[:-1])
            yield _batch(_ROW, n, chunk=np.full(n, chunk), doc_id=batch.column("doc_id"), n_a=b.n_a, n_b=b.n_b, n_links=links,
                         n_groups=np.bincount(doc_a[b.cut_a], minlength=n), links=list(map(pack, numbers)),
                         groups_sha256=[hashlib.sha256(g.encode()).hexdigest() if g else "" for g in own.groups(b)])
        yield from pairs_of(chunk, known)

    def pairs_of(chunk: int, known: Dictionary) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(known.pairs), 50_000):
            pairs = known.pairs[lo:lo + 50_000]
            yield _batch(_ROW, len(pairs), chunk=np.full(len(pairs), chunk), number=np.arange(lo, lo + len(pairs)),
                         pair=pairs, n=known.counts[lo:lo + len(pairs)])

    return whole_text(docs).mapInArrow(run, _ROW_SQL)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, total, best): links of every id pair, and whether no pair of its B id has more."""
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total"))
    same_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(_B_MASK)))  # one row per A id at most
    return totals.select("pair", "total", (F.col("total") == F.max("total").over(same_b)).alias("best"))


def report(docs: DataFrame, a_path: str, b_path: str, workspace: Workspace, most_pairs: int = DICTIONARY_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per document."""
    measured = stash(_measure(docs, a_path, b_path, most_pairs), workspace, "aligned")
    pairs = measured.where("pair IS NOT NULL").select("chunk", "number", "pair", "n")
    known = pairs.select("chunk", "number", "pair").join(pair_counts(pairs), "pair")
    nothing = {f: F.lit(None).cast(t) for f, t in (x.split(" ") for x in _ROW_SQL.split(", ")) if f not in ("chunk", "number")}
    answers = known.select("chunk", "number", F.col("total").alias("value"), F.col("best"), *(
        nothing[f].alias(f) for f in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")))
    rows = measured.where("links IS NOT NULL").select("chunk", "number", F.lit(None).cast("long").alias("value"), F.lit(None).cast("boolean").alias("best"),
                                                      "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    met = answers.unionByName(rows).repartition("chunk").sortWithinPartitions("chunk", F.col("number").asc_nulls_last())
    return met.mapInArrow(_scores, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every chunk brings the counts of its pairs first, in the order of their numbers, then its documents."""
    chunk, parts, counts, best = None, [], None, None
    for batch in batches:
        ids = batch.column("chunk").to_numpy()
        edges = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        for lo, hi in zip([0, *edges], [*edges, len(ids)]):
            if lo == hi:
                continue
            if ids[lo] != chunk:
                chunk, parts, counts = ids[lo], [], None
            run = batch.slice(lo, hi - lo)
            lookups = run.num_rows - run.column("number").null_count
            if lookups:
                parts.append((run.column("value").slice(0, lookups).to_numpy(), run.column("best").slice(0, lookups).to_numpy(zero_copy_only=False)))
            run = run.slice(lookups)
            if not run.num_rows:
                continue
            if counts is None:
                counts = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)])
                best = np.concatenate([np.zeros(0, bool), *(p[1] for p in parts)])
                parts = []
            sums = []
            for blob in run.column("links").to_pylist():
                at, n = unpack(blob)
                sums.append((int(n[best[at]].sum()), int((counts[at] * n).sum())))
            n_best, count_sum = zip(*sums)
            yield pa.RecordBatch.from_arrays(
                [*(run.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(n_best, pa.int64()),
                 pa.array(count_sum, pa.int64()), run.column("groups_sha256")],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
