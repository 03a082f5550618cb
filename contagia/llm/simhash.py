"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bit positions gets a non-zero vector of radius + 1 bits. For
every non-zero v there is one table, whose mask keeps the positions whose
vector has odd parity with v. Any `radius` positions leave some v orthogonal to
all their vectors, so two fingerprints that differ in at most `radius` bits
agree under the mask of v: every pair collides in some table, without chance.

Equal fingerprints are merged first. A bucket is read as a sorted stream. What
leaves a bucket is a forest over its linked members, not its pairs. A bucket of
more than `bucket_rows` fingerprints is not compared inside: its members go on
to a second exact search, in which fingerprints meet at the points halfway
between them (at most radius / 2 flips away), where at most as many members can
meet as there are such points. No pair is lost, no bucket is capped.

Defined results: a null or empty text has fingerprint zero and is linked like
any other; null ids do not count for the smallest id of a component; repeated
rows each get a row; extra columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contagia.functions.joins import spread_join
from contagia.llm.common import fresh_name, stash, text_chunks, whole_text
from contagia.llm.components import components
from contagia.sources.workspace import Workspace

BITS = 64
SHINGLE = 4
RADIUS = 4
SEED = 42
BUCKET_ROWS = 2048


def text_hashes(text: str, size: int = SHINGLE) -> list[int]:
    words = text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-size]]).tolist()
    return [xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, (ends[size - 1:] - 1).tolist())]


def _fold(hashes: list[list[int]]) -> np.ndarray:
    """Fingerprints: a bit is set where more than half of the hashes have it."""
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(hashes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        flat = np.fromiter((h for hs in hashes for h in hs), np.uint64, int(sizes.sum()))
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1)
        firsts = (np.cumsum(sizes) - sizes)[some]
        counts = np.add.reduceat(bits, firsts, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * counts > sizes[some, None], axis=1).reshape(-1).view("<u8")
    return out


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint as the signed long of its 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            fp = _fold([text_hashes(t, size) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return whole_text(docs).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """One mask per table; every set of `radius` positions is left out by one of them."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) of the linked components of a bucket."""
    n = len(fps)
    label = np.arange(n)
    near = np.zeros((n, n), bool)
    for lo in range(0, n, 256):
        near[lo:lo + 256] = np.bitwise_count(fps[lo:lo + 256, None] ^ fps[None, :]) <= radius
    while True:
        after = label.copy()
        for lo in range(0, n, 256):
            after[lo:lo + 256] = np.where(near[lo:lo + 256], label[None, :], n).min(axis=1)
        after = after[after]
        if (after == label).all():
            break
        label = after
    out = np.flatnonzero(label != np.arange(n))
    return fps[out], fps[label[out]]


def _bucket_edges(radius: int, bucket_rows: int):
    """Over rows sorted by bucket: edges inside each, and the members of large ones (with a null end)."""

    def flush(t: np.ndarray, k: np.ndarray, f: np.ndarray):
        cut = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
        starts, stops = np.concatenate([[0], cut]), np.concatenate([cut, [len(f)]])
        sizes = stops - starts
        ends_a, ends_b = [], []
        run = np.repeat(np.arange(len(starts)), sizes)
        for gap in range(1, 17):  # small buckets, all at once
            i = np.flatnonzero((run[gap:] == run[:-gap]) & (sizes[run[:-gap]] <= 16))
            if not len(i):
                break
            i = i[np.bitwise_count(f[i] ^ f[i + gap]) <= radius]
            ends_a.append(f[i])
            ends_b.append(f[i + gap])
        for j in np.flatnonzero(sizes > 16):
            a, b = _forest(f[starts[j]:stops[j]], radius)
            ends_a.append(a)
            ends_b.append(b)
        return (np.concatenate(ends_a), np.concatenate(ends_b)) if ends_a else (f[:0], f[:0])

    def batch_of(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        other = pa.array(b.view(np.int64)) if b is not None else pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), other], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        large: tuple[int, int] | None = None  # the bucket that was found too large
        for batch in batches:
            t, k, f = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "masked", "fp"))
            f = f.view(np.uint64)
            if held is not None:
                t, k, f = (np.concatenate(x) for x in zip(held, (t, k, f)))
                held = None
            if large is not None:
                on = int(np.argmin(np.append((t == large[0]) & (k == large[1]), False)))
                if on:
                    yield batch_of(f[:on], None)
                    t, k, f = t[on:], k[on:], f[on:]
                if len(f):
                    large = None
            if not len(f):
                continue
            change = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            edges = np.concatenate([[0], change, [len(f)]])
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi - lo > bucket_rows:
                    yield batch_of(f[lo:hi], None)
            last = int(edges[-2])
            if len(f) - last > bucket_rows:
                large = int(t[-1]), int(k[-1])
            else:
                held = t[last:], k[last:], f[last:]
            sizes = np.diff(edges)
            keep = np.repeat((sizes > 1) & (sizes <= bucket_rows) & (np.arange(len(sizes)) < len(sizes) - 1), sizes)
            if keep.any():
                a, b = flush(t[keep], k[keep], f[keep])
                if len(a):
                    yield batch_of(a, b)
        if held is not None and len(held[0]) > 1:
            a, b = flush(*held)
            if len(a):
                yield batch_of(a, b)

    return run


def _halfway(radius: int):
    """Points up to half the radius away (rounded up) from each fingerprint."""
    flips = np.array([0, *(sum(1 << i for i in c) for n in range(1, -(-radius // 2) + 1) for c in combinations(range(BITS), n))], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column("fp").to_numpy().view(np.uint64)
            for lo in range(0, len(f), 64):
                z = (f[lo:lo + 64, None] ^ flips[None, :]).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(z.view(np.int64)), pa.array(np.repeat(f[lo:lo + 64], len(flips)).view(np.int64))], ["z", "fp"])

    return run


def links(fps: DataFrame, workspace: Workspace, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) of distinct fingerprints that span the links within `radius`."""
    tables = F.array(*(F.struct(F.lit(t).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("masked"))
                       for t, m in enumerate(covering_masks(radius))))
    rows = fps.select("fp", F.explode(tables).alias("h")).select("h.*", "fp")
    found = stash(rows.repartition("t", "masked").sortWithinPartitions("t", "masked")
                  .mapInArrow(_bucket_edges(radius, bucket_rows), "a long, b long"), workspace, "found")
    crowded = found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    points = crowded.mapInArrow(_halfway(radius), "z long, fp long")
    # Members of one point are at most as many as points around it, so this window is small.
    first = F.min("fp").over(Window.partitionBy("z"))
    pairs = points.select("fp", first.alias("b")).where("fp <> b").distinct()
    if radius % 2:
        raise ValueError("points halfway need an even radius")
    return found.where("b IS NOT NULL").unionByName(pairs.select(F.col("fp").alias("a"), "b")).distinct()


def _named(distinct: DataFrame, workspace: Workspace, radius: int, bucket_rows: int) -> DataFrame:
    """(fp, first, root): the component of every distinct fingerprint (fp, first)."""
    roots = components(links(distinct.select("fp"), workspace, radius, bucket_rows), workspace)
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame, workspace: Workspace, radius: int = RADIUS, size: int = SHINGLE, bucket_rows: int = BUCKET_ROWS,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of one document of each component: the
    one with the smallest id (null last). Of rows that share id and fingerprint
    the first by text stays."""

    print_, id_, turn_ = (fresh_name(docs, c) for c in ("fp", "id", "turn"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text_col):
            fp = _fold([text_hashes(t or "", size) for t in batch.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], [*batch.schema.names, print_])

    schema = T.StructType([*docs.schema.fields, T.StructField(print_, T.LongType())])
    last = F.lit(2**63 - 1)
    marked = docs.mapInArrow(mark, schema).withColumn(id_, F.coalesce(F.col(id_col).cast("long"), last))
    distinct = stash(marked.groupBy(F.col(print_).alias("fp")).agg(F.min(id_).alias("first")), workspace, "distinct")
    rooted = _named(distinct, workspace, radius, bucket_rows)
    # The winner of a component: its smallest id, in its smallest fingerprint with that id.
    winners = rooted.groupBy("root").agg(F.min(F.struct("first", "fp")).alias("w")).select(F.col("w.fp").alias(print_), F.col("w.first").alias(id_))
    held = marked.join(stash(winners, workspace, "winners"), [print_, id_], "left_semi")
    turn = F.row_number().over(Window.partitionBy(print_, id_).orderBy(text_col))
    return held.withColumn(turn_, turn).where(F.col(turn_) == 1).select(*docs.columns)


def near_duplicates(docs: DataFrame, workspace: Workspace, radius: int = RADIUS, size: int = SHINGLE,
                    bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document."""
    marked = stash(fingerprints(docs, size), workspace, "fingerprints")
    distinct = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), workspace, "distinct")
    rooted = _named(distinct, workspace, radius, bucket_rows)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stash(spread_join(rooted, least, ["root"], ["fp"]).select("fp", "component_id"), workspace, "named")
    return spread_join(marked, named, ["fp"], ["doc_id"], spread=8).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
