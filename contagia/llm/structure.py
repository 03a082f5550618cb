"""Repair of the structure of conversations.

A legal conversation is empty, or an optional system turn followed by one or
more pairs of a user and an assistant turn. Turns that are blank, that repeat
an earlier turn, or that are cut off are found over the whole table; then the
cheapest edits (keep, rerole, delete, insert) that make every conversation
legal are found from its sequence of roles and faults alone. Sequences are
solved once each, and all sequences of a task under one grammar (rolegrammar).

A conversation is cut where the sorted table is cut. The pieces of one that
lies in several parts are solved apart, as matrices over states; only those,
one small row per piece, meet in one place, so no conversation has to fit
into a task. Its edits as one string, and the digest of its repaired text, are
for the report: the digest of a conversation reads its turns in order, as a
stream.

Defined results: null texts and roles are one space; a null conversation id is
a conversation of its own; turns are taken by number, null first, and turns of
one number by role and text (its first 64 characters, then its hash); a turn
whose role begins with none of s, u and a cannot be kept; a conversation of
which no turn is left has zeros, no edits, and the digest of an empty text;
other columns are left behind; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contagia.functions.joins import spread_join
from contagia.llm import rolegrammar
from contagia.llm.common import SPACES, stash
from contagia.llm.rolegrammar import Grammar
from contagia.sources.workspace import Workspace

ROWS_PER_PART = 200_000
#: Symbols of all sequences that share one grammar.
GRAMMAR_SYMBOLS = 200_000
#: End of a piece that is not the state alone: to be chosen, or with what is missing after it.
BEST, AND_CLOSE = -1, 4
_SAID = {1: "system", 2: "user", 3: "assistant"}


def _key() -> Column:
    """Key of a conversation: a null id is a key of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def damage(turns: DataFrame) -> DataFrame:
    """The faults of the contract, by a checksum of conversation and turn; nulls become one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(blank("role")).alias("role"),
                        text.alias("text"), fault.alias("fault")).where("fault <> 0") \
        .withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fault", "copy")


def _placed(turns: DataFrame, workspace: Workspace, rows_per_part: int) -> DataFrame:
    """(part, place, conv, turn, role, text): the turns in order, stored."""
    tidy = turns.select(_key().alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    n = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tidy.count() // rows_per_part))
    order = "conv", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64), F.xxhash64("text")
    return stash(tidy.repartitionByRange(n, *order).sortWithinPartitions(*order)
                 .select(F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("place"), "*"), workspace, "turns")


def _role(role: str | Column) -> Column:
    return F.coalesce(*(F.when(F.left(role, F.lit(1)) == name[0], code) for code, name in _SAID.items()), F.lit(0))


def faults(placed: DataFrame) -> DataFrame:
    """(part, place, conv, role, letter, blank, duplicate, truncated): the first fault of every turn counts."""
    body = F.rtrim("text", F.lit(SPACES))
    marks = placed.select("part", "place", "conv", "role", _role(F.col("role")).alias("code"), F.left("role", F.lit(1)).alias("letter"), (body == "").alias("blank"),
                          (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    again = (marks.where("NOT blank").groupBy("conv", "role", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n"))
             .where("n > 1").drop("n"))
    marks = spread_join(marks, again, ["conv", "role", "digest"], ["place"], "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    return marks.select("part", "place", "conv", "code", "letter", "blank", duplicate.alias("duplicate"), (F.col("cut") & ~F.col("blank") & ~duplicate).alias("truncated"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per part and conversation, from turns in order."""
    held: pa.Table | None = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        conv = held.column("conv").combine_chunks().dictionary_encode().indices.to_numpy()
        part = held.column("part").to_numpy()
        edges = np.flatnonzero((conv[1:] != conv[:-1]) | (part[1:] != part[:-1])) + 1
        if len(edges):
            yield _summary(held.slice(0, edges[-1]), np.concatenate([[0], edges]))
            held = held.slice(edges[-1])
    if held is not None and held.num_rows:
        yield _summary(held, np.array([0, held.num_rows]))


_PIECE = "part long, conv string, symbols binary, blank long, duplicate long, truncated long, illegal long, first string, last string"


def _summary(turns: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
    flags = {c: turns.column(c).to_numpy().astype(np.int64) for c in ("code", "blank", "duplicate", "truncated")}
    letters = np.array(turns.column("letter").to_pylist(), object)
    symbols = np.where(flags["blank"] + flags["duplicate"], rolegrammar.GONE, 1 + 2 * flags["code"] + flags["truncated"]).astype(np.uint8).tobytes()
    legal = np.array([a + b in ("su", "ua", "au") for a, b in zip(letters[:-1], letters[1:])] + [True])
    legal[edges[1:] - 1] = True
    lo, hi = edges[:-1], edges[1:]
    sums = [np.add.reduceat(x, lo) for x in (flags["blank"], flags["duplicate"], flags["truncated"], (~legal).astype(np.int64))]
    return pa.RecordBatch.from_arrays(
        [turns.column("part").combine_chunks().take(pa.array(lo)), turns.column("conv").combine_chunks().take(pa.array(lo)),
         pa.array([symbols[a:b] for a, b in zip(lo.tolist(), hi.tolist())], pa.binary()), *map(pa.array, sums),
         pa.array(letters[lo], pa.string()), pa.array(letters[hi - 1], pa.string())],
        ["part", "conv", "symbols", "blank", "duplicate", "truncated", "illegal", "first", "last"])


def _under_grammars(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Grammar]]:
    """Rows with a grammar of their sequences, at most about GRAMMAR_SYMBOLS (or one row) at a time."""
    for batch in batches:
        sizes = np.cumsum([len(x) for x in batch.column("symbols").to_pylist()], dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            done = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, done + GRAMMAR_SYMBOLS, side="right")))
            run = batch.slice(lo, hi - lo)
            yield run, Grammar(run.column("symbols").to_pylist())
            lo = hi


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run, grammar in _under_grammars(batches):
        flat = [pa.array(x[grammar.root].reshape(-1, 16).tolist(), pa.list_(pa.int64())) for x in (grammar.cost, grammar.rank)]
        yield pa.RecordBatch.from_arrays([run.column("part"), run.column("conv"), *flat], ["part", "conv", "cost", "rank"])


def _compose(pieces: pd.DataFrame) -> pd.DataFrame:
    """States before and after every piece of one conversation."""
    pieces = pieces.sort_values("part")
    cost, rank = (np.stack(pieces[c].to_list()).reshape(-1, 4, 4) for c in ("cost", "rank"))
    behind, choice = np.array([rolegrammar.COST[rolegrammar.INSERT] * m for m in rolegrammar.MISSING]), []
    for c, r in zip(cost[::-1], rank[::-1]):
        key = np.minimum(c + behind, rolegrammar.FAR) * 4 + r
        choice.append(key.argmin(axis=1))
        behind = key.min(axis=1) // 4
    state, begin, end = rolegrammar.START, [], []
    for to in choice[::-1]:
        begin.append(state)
        state = int(to[state])
        end.append(state)
    end[-1] += AND_CLOSE
    return pieces[["part", "conv"]].assign(begin=begin, end=end)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run, grammar in _under_grammars(batches):
        audits, costs = [], []
        for root, begin, end in zip(grammar.root, run.column("begin").to_pylist(), run.column("end").to_pylist()):
            last = grammar.best_end(root, begin) if end == BEST else end % AND_CLOSE
            tail = "" if 0 <= end < AND_CLOSE else rolegrammar.closing(last)
            audits.append(grammar.edits(root, begin, last) + tail)
            costs.append(int(grammar.cost[root, begin, last]) + rolegrammar.COST[rolegrammar.INSERT] * len(tail))
        yield pa.RecordBatch.from_arrays([run.column("symbols"), run.column("begin"), run.column("end"), pa.array(audits, pa.string()), pa.array(costs, pa.int64())],
                                         ["symbols", "begin", "end", "audit", "cost"])


def solve(pieces: DataFrame) -> DataFrame:
    """The pieces with their state before (`begin`), whether they are `whole` conversations, edits and cost."""
    several = pieces.groupBy("conv").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("conv")
    long = pieces.join(several, "conv", "left_semi").select("part", "conv", "symbols")
    states = long.mapInArrow(_matrices, "part long, conv string, cost array<long>, rank array<long>") \
        .groupBy("conv").applyInPandas(_compose, "part long, conv string, begin int, end int")
    wanted = pieces.join(states, ["part", "conv"], "left").withColumn("whole", F.col("begin").isNull()) \
        .fillna({"begin": rolegrammar.START, "end": BEST})
    key = ["symbols", "begin", "end"]
    audits = wanted.select(*key).distinct().mapInArrow(_audits, "symbols binary, begin int, end int, audit string, cost long")
    return spread_join(wanted, audits, key, ["part", "conv"]).drop("symbols", "end")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, str], bool, list[tuple[int, int, str, str, str]]]]:
    """(piece, whether it is a whole conversation, repaired turns (place, step, edit, role, text)), bit by bit, in order.

    Every piece brings its edits first (`audit` is set), then its turns."""
    key, whole, parts, at, state, last = None, True, [], 0, 0, -1

    def tail() -> list[tuple]:
        extra = parts[at] if at < len(parts) else ""
        return [(last, k + 1, rolegrammar.INSERT, _SAID[r], "") for k, r in enumerate(rolegrammar.apply(extra, state, 0)[0])]

    for batch in batches:
        out: list[tuple] = []
        for part, conv, place, audit, begin, single, code, role, text in zip(*(batch.column(c).to_pylist() for c in _MET)):
            if audit is not None:
                if key is not None:
                    yield key, whole, out + tail()
                key, whole, parts, at, state, out = (part, conv), single, rolegrammar.per_turn(audit), 0, begin, []
                continue
            inserted, given, state = rolegrammar.apply(parts[at], state, code)
            edit, last = parts[at][-1], place
            out += [(place, k - len(inserted), rolegrammar.INSERT, _SAID[r], "") for k, r in enumerate(inserted)]
            if given is not None:
                out.append((place, 0, edit, role if edit == rolegrammar.KEEP else _SAID[given], text))
            at += 1
        if key is not None and out:
            yield key, whole, out
    if key is not None:
        yield key, whole, tail()


_MET = ("part", "conv", "place", "audit", "begin", "whole", "code", "role", "text")


def _met(placed: DataFrame, solved: DataFrame) -> DataFrame:
    edits = solved.select("part", "conv", F.lit(-1).cast("long").alias("place"), "audit", "begin", "whole", F.lit(None).cast("int").alias("code"),
                          *(F.lit(None).cast("string").alias(c) for c in ("role", "text")))
    turns = placed.select("part", "conv", "place", F.lit(None).cast("string").alias("audit"), F.lit(None).cast("int").alias("begin"),
                          F.lit(None).cast("boolean").alias("whole"), _role(F.col("role")).alias("code"), "role", "text")
    return edits.unionByName(turns).repartition("part", "conv").sortWithinPartitions("part", "conv", "place")


def _turn_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (part, conv), _, turns in _edited(batches):
        if turns:
            yield pa.RecordBatch.from_pylist([dict(zip(("conv", "part", "place", "step", "edit", "role", "text"), (conv, part, *t))) for t in turns],
                                             schema=pa.schema([("conv", pa.string()), ("part", pa.int64()), ("place", pa.int64()), ("step", pa.int32()),
                                                               ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, sha256) of whole conversations; the lines of others are passed on as they are."""
    rows: list[tuple] = []
    key, sha, lines = None, None, 0

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        conv, digest, place, step, line = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(conv, pa.string()), pa.array(digest, pa.string()), pa.array(place, pa.int64()),
                                           pa.array(step, pa.int32()), pa.array(line, pa.string())], ["conv", "sha256", "place", "step", "line"])

    for own, whole, turns in _edited(batches):
        if own != key:
            if sha is not None:
                rows.append((key[1], sha.hexdigest(), None, None, None))
            key, sha, lines = own, hashlib.sha256() if whole else None, 0
        for place, step, _, role, text in turns:
            if sha is None:
                rows.append((own[1], None, place, step, f"{role}:{text}"))
            else:
                sha.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
        if len(rows) > 2000:
            yield flush(rows)
            rows = []
    if sha is not None:
        rows.append((key[1], sha.hexdigest(), None, None, None))
    if rows:
        yield flush(rows)


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, sha256) from lines in order."""
    key, sha = None, None
    for batch in batches:
        done = []
        for conv, line in zip(batch.column("conv").to_pylist(), batch.column("line").to_pylist()):
            if conv != key:
                if key is not None:
                    done.append((key, sha.hexdigest()))
                key, sha = conv, hashlib.sha256(line.encode())
            else:
                sha.update(b"\n" + line.encode())
        if done:
            yield pa.RecordBatch.from_pylist([{"conv": c, "sha256": s} for c, s in done])
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"conv": key, "sha256": sha.hexdigest()}])


def _solved(turns: DataFrame, workspace: Workspace, rows_per_part: int) -> tuple[DataFrame, DataFrame]:
    placed = _placed(turns, workspace, rows_per_part)
    in_order = faults(placed).repartition("part").sortWithinPartitions("part", "place")
    pieces = stash(in_order.mapInArrow(_pieces, _PIECE), workspace, "pieces")
    return placed, stash(solve(pieces), workspace, "solved")


def repair(turns: DataFrame, workspace: Workspace, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """(conv, part, place, step, edit, role, text): the turns of the repaired conversations, in order of part, place and step.

    `conv` is '=' and the conversation id, or empty for a null id; inserted turns have a step unlike zero."""
    return _met(*_solved(turns, workspace, rows_per_part)).mapInArrow(
        _turn_rows, "conv string, part long, place long, step int, edit string, role string, text string")


def report(turns: DataFrame, originals: DataFrame, workspace: Workspace, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per id in `originals`."""
    placed, solved = _solved(turns, workspace, rows_per_part)
    gaps = placed.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    row = F.struct("part", "audit", "first", "last")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    # A conversation has one piece, or as many as the parts of the table that it covers.
    one = solved.groupBy("conv").agg(*sums, F.sort_array(F.collect_list(row)).alias("pieces"))
    seam = F.transform(F.arrays_zip(F.expr("slice(pieces.last, 1, size(pieces) - 1)").alias("a"), F.expr("slice(pieces.first, 2, size(pieces))").alias("b")),
                       lambda x: F.when(F.concat(x["a"], x["b"]).isin("su", "ua", "au"), 0).otherwise(1))
    one = one.withColumn("illegal", F.col("illegal") + F.aggregate(seam, F.lit(0).cast("long"), lambda s, x: s + x)) \
        .withColumn("audit", F.array_join("pieces.audit", "")).drop("pieces")
    lines = stash(_met(placed, solved).mapInArrow(_digests, "conv string, sha256 string, place long, step int, line string"), workspace, "digests")
    long = lines.where("line IS NOT NULL").repartition("conv").sortWithinPartitions("conv", "place", "step").select("conv", "line")
    shas = lines.where("sha256 IS NOT NULL").select("conv", "sha256").unionByName(long.mapInArrow(_hash_lines, "conv string, sha256 string"))
    found = originals.select("conv_id").distinct().withColumn("conv", _key())
    for other in (gaps, one, shas):
        found = found.join(other, "conv", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    empty = hashlib.sha256(b"").hexdigest()
    return found.select("conv_id", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256"))
