"""Removal of byte strings that occurred before, by prefix doubling.

A position is named by the string that starts there: the name of 2h bytes is
made from the names of h bytes at the position and h further on, up to 32, 64
and the threshold of 100 bytes. Names need no numbering, since a task can make
them from a text alone; what needs the corpus is which of them are unique.
Spark sorts pairs of names with their positions, retires the unique ones, and
names the rest anew at a finer grain, until nothing is left to decide:

1. Of all 32-byte names inside a window of 100 bytes the smallest is its
   anchor. Equal windows have equal anchors, so windows that share an anchor
   (about 35) form one row: pair (anchor name, name of all their bytes).
2. Rows whose anchor name is repeated, but with other bytes around, are split
   into blocks of eight windows: pair (name of the 93 bytes that all windows
   of the block have, name of all its 107 bytes).
3. What is still open is split into single windows: pair of two names of the
   same 100 bytes.

In each sort, a pair seen before means that all its windows are repeats. A
first name seen once, or only with one second name, ends the matter. So each
position of the corpus is sorted once at most in groups of 35, and single
windows are only compared at the ends of repeats.

Copies inside one chunk of a task are settled there, so a passage in a third of
all documents sends one row per chunk, not one per document. Sorted runs are
read as a stream that keeps one pending row, whatever the length of a run.

Texts are dealt once, compressed, to a bucketed table, and later joins only move
positions.

Defined results: a null text is empty; a null doc_id comes before all others;
rows of the same doc_id are documents of their own, ordered by a hash of their
text (of equal ones the second is a copy of the first); extra columns are left behind.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contagia.llm.common import ragged, stash, text_chunks, whole_text
from contagia.sources.workspace import Workspace

LENGTH = 100
_BASE = 32
_SPAN = LENGTH - _BASE + 1
_BLOCK = 8
#: Bytes of text in one bucket of the dealt table, and named at a time.
BUCKET_BYTES = 32 << 20
_CHUNK = 1 << 20
_LOW = np.uint64((1 << 22) - 1)
_TABLE = np.frombuffer(hashlib.shake_128(b"names of single bytes").digest(2048), "<u8")
_ODD = np.frombuffer(hashlib.shake_128(b"multipliers").digest(64), "<u8") | np.uint64(1)
_FIRST = -(2**63)
#: A row of `count` windows from `start`: its place is copy * 2^32 + start, its shape
#: (anchor - start) * 128 + count while it is open, and count once it is settled.
PAIRS = "name long, whole long, ord long, place long, shape int, settled boolean"
SPOTS = "ord long, place long, shape int, repeat boolean"


def _mix(a: np.ndarray, b: np.ndarray, k: int = 0) -> np.ndarray:
    x = a * _ODD[k] + (b ^ (b >> np.uint64(29))) * _ODD[k + 1]
    x ^= x >> np.uint64(32)
    x *= _ODD[7]
    x ^= x >> np.uint64(29)
    return x


class Names:
    """Names of all positions of a buffer, by doubling."""

    def __init__(self, raw: np.ndarray) -> None:
        h, size = _TABLE[raw], 1
        while size < _BASE:
            h = _mix(h[:-size], h[size:]) if len(h) > size else h[:0]
            size *= 2
        self.base = h

    def at64(self, i: np.ndarray) -> np.ndarray:
        return _mix(self.base[i], self.base[i + _BASE])

    def at93(self, i: np.ndarray) -> np.ndarray:
        return _mix(self.at64(i), self.at64(i + 29), 1)

    def at100(self, i: np.ndarray, k: int = 2) -> np.ndarray:
        return _mix(self.at64(i), self.at64(i + 36), k)

    def anchors(self) -> np.ndarray:
        """For every window, the position of its smallest 32-byte name, the first in a tie."""
        assert len(self.base) <= int(_LOW) + 1, "a position has 22 bits"
        low = (self.base & ~_LOW) | np.arange(len(self.base), dtype=np.uint64)
        size = 1
        while size * 2 <= _SPAN:
            low = np.minimum(low[:-size], low[size:]) if len(low) > size else low[:0]
            size *= 2
        rest = _SPAN - size
        low = np.minimum(low[:-rest], low[rest:]) if len(low) > rest else low[:0]
        return (low & _LOW).astype(np.int64)


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), sizes


def _group_rows(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Rows of step 1: (document, name, whole, start, count, anchor), positions inside the document."""
    raw, sizes = _buffer(texts)
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    if len(raw) < LENGTH:
        return none
    names, firsts = Names(raw), np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), np.maximum(sizes - LENGTH + 1, 0))
    counts = np.maximum(sizes - LENGTH + 1, 0)
    if not len(owner):
        return none
    windows = np.arange(len(owner)) + np.repeat(firsts - (np.cumsum(counts) - counts), counts)
    anchor = names.anchors()[windows]
    new = np.ones(len(owner), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(owner)))
    start, anchor, owner = windows[at], anchor[at], owner[at]
    shape = ((anchor - start) * 128 + count).astype(np.uint64)
    whole = _mix(_mix(names.at100(start), names.at100(start + count - 1), 3), _TABLE[shape % np.uint64(256)] + shape, 4)
    return owner, names.base[anchor], whole, start - firsts[owner], count, anchor - firsts[owner]


def _split_rows(text: bytes, spots: list[dict], size: int) -> tuple[np.ndarray, ...]:
    """Rows of steps 2 and 3 for the open windows of one document."""
    names = Names(np.frombuffer(text, np.uint8))
    start = np.array([s["start"] for s in spots], np.int64)
    count = np.array([s["count"] for s in spots], np.int64)
    anchor = np.repeat(np.array([s["anchor"] for s in spots], np.int64), count)
    window = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
    if size == 1:
        return names.at100(window), names.at100(window, 5), window, np.ones_like(window), anchor
    block = (window - anchor) // size  # same for equal windows, wherever they lie
    new = np.ones(len(window), bool)
    new[1:] = (block[1:] != block[:-1]) | (anchor[1:] != anchor[:-1])
    at = np.flatnonzero(new)
    first = anchor[at] + block[at] * size  # first window of the full block
    last, n = first + size - 1, np.diff(np.append(at, len(window)))
    core = _mix(names.at93(last), _TABLE[block[at] & 255], 5)  # with its place at the anchor, so no block meets itself
    inside = (first >= 0) & (last + LENGTH <= len(text))
    own = (window[at] - first) * size + n  # a block cut by an end of the text is only whole for the same cut
    lo, hi = np.where(inside, first, window[at]), np.where(inside, last, window[at] + n - 1)
    shape = np.where(inside, 0, own).astype(np.uint64)
    whole = _mix(_mix(names.at100(lo), names.at100(hi), 3), _TABLE[shape % np.uint64(256)] + shape, 4)
    return core, whole, window[at], n, anchor[at]


def _settle(name, whole, order, copy, start, count, anchor) -> pa.RecordBatch:
    """Marks pairs that occur earlier in the same chunk; only the first has to be compared further.

    Settled rows that follow one another are joined, and get names of their own
    so that they are dealt evenly."""
    place = (copy.astype(np.int64) << 32) + start
    by = np.lexsort((place, order, whole, name))
    again = np.zeros(len(by), bool)
    again[1:] = (name[by][1:] == name[by][:-1]) & (whole[by][1:] == whole[by][:-1])
    settled = np.zeros(len(by), bool)
    settled[by] = again
    open_ = np.flatnonzero(~settled)
    old = np.flatnonzero(settled)
    old = old[np.lexsort((place[old], order[old]))]
    new = np.ones(len(old), bool)
    new[1:] = (order[old][1:] != order[old][:-1]) | (place[old][1:] != place[old][:-1] + count[old][:-1])
    first = old[new]
    total = np.add.reduceat(count[old], np.flatnonzero(new)) if len(old) else np.zeros(0, np.int64)
    rows = np.concatenate([open_, first])
    names = np.concatenate([name[open_], _mix(place[first].astype(np.uint64), order[first].astype(np.uint64))])
    shape = np.concatenate([(anchor - start)[open_] * 128 + count[open_], total])
    return pa.RecordBatch.from_arrays(
        [pa.array(names.view(np.int64)), pa.array(whole[rows].view(np.int64)), pa.array(order[rows], pa.int64()), pa.array(place[rows]),
         pa.array(shape, pa.int32()), pa.array(np.arange(len(rows)) >= len(open_))], ["name", "whole", "ord", "place", "shape", "settled"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut by the bytes that texts have unpacked, however well they compress."""
    return text_chunks(batches, limit=_CHUNK, size="n_bytes")


def _unpack(texts: pa.Array) -> list[bytes]:
    unzip = zstandard.ZstdDecompressor()
    return [unzip.decompress(t) for t in texts.to_pylist()]


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _chunks(batches):
        orders, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ord", "copy"))
        pieces = [(i, at, t[at:at + _CHUNK + LENGTH - 1]) for i, t in enumerate(_unpack(batch.column("packed")))
                  for at in range(0, max(len(t), 1), _CHUNK)]
        together = len(pieces) if len(pieces) == batch.num_rows else 1  # parts of a long text go one by one
        for lo in range(0, len(pieces), max(together, 1)):
            some = pieces[lo:lo + together]
            owner, name, whole, start, count, anchor = _group_rows([p[2] for p in some])
            if len(owner):
                row, at = (np.array([p[k] for p in some], np.int64)[owner] for k in (0, 1))
                yield _settle(name, whole, orders[row], copies[row], start + at, count, anchor + at)


def _finer_pairs(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            parts = [_split_rows(t, s, size) for t, s in zip(_unpack(batch.column("packed")), batch.column("spots").to_pylist())]
            n = [len(p[0]) for p in parts]
            name, whole, start, count, anchor = (np.concatenate(x) for x in zip(*parts))
            orders, copies = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n) for c in ("ord", "copy"))
            yield _settle(name, whole, orders, copies, start, count, anchor)
    return run


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over pairs in order: repeats, and first occurrences that need a finer look.

    A first occurrence of a pair is open if its first name has another pair
    too; the first pair of a name waits until the next one is seen.
    """
    columns = ("name", "whole", "ord", "place", "shape")
    held: list[np.ndarray] | None = None
    last: tuple[int, int] | None = None
    for batch in batches:
        done = batch.filter(batch.column("settled"))
        if done.num_rows:
            yield _spots(*(done.column(c).to_numpy() for c in columns[2:]), True)
        batch = batch.filter(pc.invert(batch.column("settled")))
        if not batch.num_rows:
            continue
        values = [batch.column(c).to_numpy() for c in columns]
        name, whole = values[0], values[1]
        new_name, new_pair = np.ones(len(name), bool), np.ones(len(name), bool)
        new_name[1:] = name[1:] != name[:-1]
        new_pair[1:] = new_name[1:] | (whole[1:] != whole[:-1])
        if last is not None:
            new_name[0] = name[0] != last[0]
            new_pair[0] = new_name[0] or whole[0] != last[1]
        last = int(name[-1]), int(whole[-1])
        firsts = np.flatnonzero(new_pair)
        rows = [v[firsts] for v in values]
        lone = new_name[firsts]
        if held is not None:
            rows = [np.concatenate([h, r]) for h, r in zip(held, rows)]
            lone = np.concatenate([[True], lone])
        held = None
        followed = np.zeros(len(lone), bool)
        followed[:-1] = ~lone[1:]
        open_ = ~lone | followed
        if len(lone) and lone[-1]:
            held, open_[-1] = [r[-1:] for r in rows], False
        again = ~new_pair
        if again.any():
            order, place, shape = (v[again] for v in values[2:])
            yield _spots(order, place, shape & 127, True)
        if open_.any():
            yield _spots(*(r[open_] for r in rows[2:]), False)


def _spots(order: np.ndarray, place: np.ndarray, shape: np.ndarray, repeat: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(place, pa.int64()), pa.array(shape, pa.int32()),
                                       pa.array(np.full(len(order), repeat))], ["ord", "place", "shape", "repeat"])


def _rank(pairs: DataFrame) -> DataFrame:
    """Sort the pairs and decide them; settled ones only pass."""
    return pairs.repartition(F.col("name")).sortWithinPartitions("name", "whole", "ord", "place").mapInArrow(_decide, SPOTS)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches):
        zip_ = zstandard.ZstdCompressor(level=3)
        texts = [t.encode() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array([len(t) for t in texts], pa.int64()),
             pa.array([zip_.compress(t) for t in texts], pa.binary())], ["doc_id", "text_key", "n_bytes", "packed"])


def _deal(docs: DataFrame, path: str, bucket_bytes: int) -> DataFrame:
    """The texts, compressed, in a table bucketed by document, with the order of documents as (ord, copy)."""
    text = whole_text(docs).withColumn("text_key", F.xxhash64("text"))
    spark = docs.sparkSession
    total = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    turn = Window.partitionBy("ord").orderBy("text_key", "packed")
    name = f"texts_{uuid.uuid4().hex}"
    (text.mapInArrow(_pack, "doc_id long, text_key long, n_bytes long, packed binary")
     .withColumn("ord", F.coalesce("doc_id", F.lit(_FIRST))).repartition(buckets, "ord")
     .withColumn("copy", F.row_number().over(turn).cast("int")).drop("text_key")
     .write.bucketBy(buckets, "ord").option("path", path).option("compression", "uncompressed").saveAsTable(name))
    return spark.table(name)


def _by_document(rows: DataFrame) -> DataFrame:
    """The open windows or repeats of each document in one list; no longer than the document."""
    start = F.col("place").bitwiseAND(F.lit(2**32 - 1)).cast("int")
    spot = F.struct(start.alias("start"), F.when(F.col("repeat"), F.col("shape")).otherwise(F.col("shape").bitwiseAND(127)).alias("count"),
                    (start + F.shiftright("shape", 7)).alias("anchor"))
    return (rows.select("ord", F.shiftright("place", 32).cast("int").alias("copy"), spot.alias("spot"))
            .groupBy("ord", "copy").agg(F.sort_array(F.collect_list("spot")).alias("spots")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _chunks(batches):
        removed, spans, starts, lengths, kept = [], [], [], [], []
        for text, spots in zip(_unpack(batch.column("packed")), batch.column("spots")):
            raw = np.frombuffer(text, np.uint8)
            edge = np.zeros(len(raw) + 1, np.int32)
            if spots.is_valid:
                own = spots.values
                start, count = (own.field(i).to_numpy() for i in (0, 1))
                np.add.at(edge, start, 1)
                np.add.at(edge, start + count - 1 + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            jump = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
            starts.append(np.flatnonzero(jump == 1))
            lengths.append(np.flatnonzero(jump == -1) - starts[-1])
            removed.append(int(gone.sum()))
            spans.append(len(starts[-1]))
            kept.append(raw[~gone].tobytes())
        n = np.array(spans, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
             ragged(np.concatenate(starts), n, pa.int32()), ragged(np.concatenate(lengths), n, pa.int32()), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "starts", "lengths", "kept"])


def remove_repeats(docs: DataFrame, workspace: Workspace, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, starts, lengths, kept) for every document."""
    spark = docs.sparkSession
    texts = _deal(docs, workspace.child("texts"), bucket_bytes)
    repeats, open_ = None, None
    for step, size in enumerate((0, _BLOCK, 1)):
        if open_ is None:
            pairs = texts.mapInArrow(_first_pairs, PAIRS)
        else:
            pairs = texts.join(_by_document(open_), ["ord", "copy"]).select("ord", "copy", "n_bytes", "packed", "spots").mapInArrow(_finer_pairs(size), PAIRS)
        ranked = stash(_rank(pairs), workspace, f"ranked{step}")
        found = ranked.where("repeat")
        repeats = found if repeats is None else repeats.unionByName(found)
        open_ = ranked.where("NOT repeat")
    joined = texts.join(_by_document(repeats), ["ord", "copy"], "left")
    return joined.select("doc_id", "n_bytes", "packed", "spots").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, starts array<int>, lengths array<int>, kept binary")


def digests(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
