"""Document fingerprints from locally consistent parsing.

A text is parsed level by level. Runs of one symbol become one symbol; the
others are labelled by deterministic coin tossing (the lowest bit in which a
symbol differs from the one before it, and its value there), again and again
until six labels are left, and a phrase begins wherever the label is a local
maximum. The phrases, named by hashes of their symbols, are the symbols of the
next level, until one is left. Where a phrase begins depends on a few symbols
around it only, so equal substrings have the same phrases inside, wherever
they stand, and equal texts have the same last name.

A fingerprint is that last name and, for each of 64 classes of names, a digest
of the least one from the second level on; the likeness of two fingerprints
is the share of classes that agree.

Defined results: a null text counts as empty; an empty text has the name zero
and no classes, and is like other empty texts only; documents are ordered by
descending id, null ids last, equal ids by a hash of their texts; a single
document is its own next one; other columns are left behind; no rows give no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contagia.llm.common import stash, text_chunks, whole_text
from contagia.sources.workspace import Workspace

CLASSES = 64
#: The first level whose names enter the classes; its phrases are about eight bytes long.
LEVEL = 2
WIDTH = 8 + 2 * CLASSES
#: Text bytes of a part of the ordered table.
PART_BYTES = 32 << 20
#: Symbols that are labelled or named at a time.
BLOCK = 1 << 20
_REACH = 8
_NONE = np.uint64(2**64 - 1)
_ODD = np.frombuffer(hashlib.shake_128(b"places in a phrase").digest(8 * 64), "<u8") | np.uint64(1)
_RUN, _KEY = np.frombuffer(hashlib.shake_128(b"runs and classes").digest(16), "<u8") | np.uint64(1)
_BYTE = np.frombuffer(hashlib.shake_128(b"names of bytes").digest(2048), "<u8")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _coin(before: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Twice the lowest bit in which two symbols differ, and the own value of that bit."""
    differ = before ^ own
    bit = np.bitwise_count((differ & (~differ + differ.dtype.type(1))) - differ.dtype.type(1)).astype(differ.dtype)
    return (2 * bit + ((own >> bit) & differ.dtype.type(1))).astype(np.uint8)


_PAIR = np.arange(1 << 16, dtype=np.uint32)
_COINS = np.where(_PAIR >> 8 == _PAIR & 255, 0, _coin(_PAIR >> 8, _PAIR & 255)).astype(np.uint8)


def labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below six, different for neighbours; `first` marks the first symbol of every document."""
    def again(x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.uint8)
        out[1:] = _COINS[x[:-1].astype(np.uint16) << 8 | x[1:]]
        out[first] = x[first] & 1
        return out

    if symbols.dtype == np.uint8:
        out = again(symbols)
    else:
        out = np.empty(len(symbols), np.uint8)
        out[1:] = _coin(symbols[:-1], symbols[1:])
        out[first] = (symbols[first] & np.uint64(1)).astype(np.uint8)
    for _ in range(3):
        out = again(out)
    return out


def _cuts(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin, block by block with what lies around."""
    out = first.copy()
    for lo in range(0, len(symbols), BLOCK):
        hi = min(lo + BLOCK, len(symbols))
        a, b = max(0, lo - _REACH), min(len(symbols), hi + 2)
        own = first[a:b].copy()
        own[0] = True
        label = labels(symbols[a:b], own)
        peak = np.zeros(b - a, bool)
        # The second and the last symbol of a document begin no phrase, so every phrase has two symbols.
        peak[2:-1] = (label[2:-1] > label[1:-2]) & (label[2:-1] > label[3:]) & ~own[2:-1] & ~own[1:-2] & ~own[3:]
        out[lo:hi] |= peak[lo - a:hi - a]
    return out


def next_level(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of all documents, and their number in each."""
    start = np.zeros(len(symbols), bool)
    start[np.cumsum(sizes) - sizes] = True
    head = start.copy()
    head[1:] |= symbols[1:] != symbols[:-1]
    begin = np.flatnonzero(head[:-1] & ~head[1:])
    length = np.flatnonzero(np.append(~head[:-1] & head[1:], not head[-1])) + 1 - begin
    place = np.cumsum(head, dtype=np.int32)[begin] - 1
    symbols, first = symbols[head], start[head]
    cut = _cuts(symbols, first)
    names, lo = [], 0
    while lo < len(symbols):
        hi = lo + BLOCK
        hi = len(symbols) if hi >= len(symbols) else hi + int(np.argmax(cut[hi:])) if cut[hi:].any() else len(symbols)
        value = _BYTE[symbols[lo:hi]] if symbols.dtype == np.uint8 else symbols[lo:hi].copy()
        a, b = np.searchsorted(place, (lo, hi))
        runs = place[a:b] - lo
        value[runs] = _mix(value[runs] + length[a:b].astype(np.uint64) * _RUN)
        at = np.flatnonzero(cut[lo:hi])
        within = np.arange(hi - lo) - np.repeat(at, np.diff(at, append=hi - lo))
        names.append(_mix(np.add.reduceat(value * _ODD[within], at)))
        lo = hi
    return np.concatenate(names), np.diff(np.flatnonzero(np.append(first[cut], True)))


def parse(raws: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, documents still parsed, number of names of each, names) of every level from the first on."""
    sizes = np.array([len(r) for r in raws], np.int64)
    live = np.flatnonzero(sizes)
    symbols, sizes, level = np.frombuffer(b"".join(raws), np.uint8), sizes[live], 0
    while len(live):
        symbols, sizes = next_level(symbols, sizes)
        level += 1
        yield level, live, sizes, symbols
        going = sizes > 1
        symbols = symbols[np.repeat(going, sizes)]
        live, sizes = live[going], sizes[going]


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of bytes per text: its last name, and a digest for each class (zero: no name)."""
    least = np.full(len(texts) * CLASSES, _NONE)
    root = np.zeros(len(texts), np.uint64)
    for level, docs, sizes, names in parse([t.encode() for t in texts]):
        done = sizes == 1
        root[docs[done]] = names[np.cumsum(sizes)[done] - 1]
        wanted = np.repeat((level >= LEVEL) | done, sizes)
        names = names[wanted] * _KEY
        at = np.repeat(docs, sizes)[wanted] * CLASSES + (names >> np.uint64(58)).astype(np.int64)
        np.minimum.at(least, at, names << np.uint64(6))
    digest = np.where(least == _NONE, 0, 1 + _mix(least) % np.uint64(65535)).astype(">u2")
    return np.concatenate([root.astype(">u8").view(np.uint8).reshape(-1, 8), digest.view(np.uint8).reshape(-1, 2 * CLASSES)], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of classes in which rows of two fingerprint tables agree, of those that either has."""
    x, y = (np.ascontiguousarray(f[:, 8:]).view(">u2") for f in (a, b))
    some = ((x > 0) | (y > 0)).sum(axis=1)
    alike = ((x == y) & (x > 0)).sum(axis=1) / np.maximum(some, 1)
    return np.where((a[:, :8] == b[:, :8]).all(axis=1), 1.0, alike)


def edited(text: str, after: str) -> str:
    """The last third of a text replaced by as much of the beginning of the next one."""
    n = len(text) // 3
    return text[:len(text) - n] + after[:n]


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _binary(fingerprints(batch.column("text").to_pylist()))],
                                             ["doc_id", "fingerprint"])

    return whole_text(docs).mapInArrow(run, "doc_id long, fingerprint binary").withColumn("fingerprint", F.lower(F.hex("fingerprint")))


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array(list(map(bytes, rows)), pa.binary())


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()),
                     ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_RESULT_SQL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double")


def _compared(ids: list[int | None], texts: list[str], own: np.ndarray, after_texts: list[str], after: np.ndarray) -> list[pa.Array]:
    changed = [edited(t, a) for t, a in zip(texts, after_texts)]
    prints = fingerprints(changed)
    return [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), _binary(own), _binary(prints),
            pa.array(likeness(own, prints)), pa.array(likeness(own, after))]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows whose next one is in the same part, then the part's first and last row (`head` is true, false)."""
    part, held = TaskContext.get().partitionId(), None
    names = [*_RESULT.names, "part", "head", "text"]

    def edge(ids: list, texts: list, prints: np.ndarray, head: bool) -> pa.RecordBatch:
        own = {"doc_id": pa.array(ids, pa.int64()), "fingerprint": _binary(prints), "part": pa.array([part], pa.int32()),
               "head": pa.array([head]), "text": pa.array(texts, pa.string())}
        return pa.RecordBatch.from_arrays([own[n] if n in own else pa.nulls(1, _RESULT.field(n).type) for n in names], names)

    for batch in text_chunks(batches, limit=1 << 20):
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        prints = fingerprints(texts)
        if held is None:
            yield edge(ids[:1], texts[:1], prints[:1], True)
        else:
            ids, texts, prints = held[0] + ids, held[1] + texts, np.concatenate([held[2], prints])
        if len(ids) > 1:
            found = _compared(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:])
            n = len(ids) - 1
            yield pa.RecordBatch.from_arrays([*found, pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.string())], names)
        held = ids[-1:], texts[-1:], prints[-1:]
    if held is not None:
        yield edge(*held, False)


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last row of every part with the first one of the part that follows."""
    for batch in batches:
        if batch.num_rows:
            own, after = (np.stack([np.frombuffer(x, np.uint8) for x in batch.column(c).to_pylist()]) for c in ("fingerprint", "next_fingerprint"))
            yield pa.RecordBatch.from_arrays(
                _compared(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), own, batch.column("next_text").to_pylist(), after),
                schema=_RESULT)


def report(docs: DataFrame, workspace: Workspace, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per document.

    The documents are dealt to ranges of descending ids, where the next one is the next row; only the edges of the
    ranges, two rows for each, are matched afterwards."""
    spark, text = docs.sparkSession, whole_text(docs)
    total = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))
    order = F.col("doc_id").desc_nulls_last(), F.xxhash64("text")
    ordered = text.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    done = stash(ordered.mapInArrow(_in_order, f"{_RESULT_SQL}, part int, head boolean, text string"), workspace, "compared")
    heads = done.where("head").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    lasts = done.where("NOT head").select("part", "doc_id", "text", "fingerprint")
    in_order = Window.orderBy("part")  # one row per part
    follows = done.where("NOT head").select("part", F.coalesce(F.lead("part").over(in_order), F.first("part").over(in_order)).alias("next_part"))
    edges = lasts.join(follows, "part").join(heads, "next_part").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
    results = done.where("head IS NULL").select(*_RESULT.names).unionByName(edges.mapInArrow(_at_edges, _RESULT_SQL))
    return results.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
