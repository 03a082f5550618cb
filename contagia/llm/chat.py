"""Chat formatting with the cheapest repair of roles.

A legal conversation is an optional system turn, then user and assistant turns
in alternation, ending with the assistant. For each turn the repair keeps its
role, merges it into the turn before, gives it another role, or puts one empty
turn before it; at the end missing turns are added empty. Dynamic programming
over the states of this automaton finds the least total cost, and of all
cheapest repairs the one whose first difference is the preferred action.

The unit of output is the rendered segment of one input turn, so a conversation
of any length is a set of rows; joined in order they are the rendered text. A
conversation is cut where the sorted table is cut. Costs to go compose over
pieces as matrices in min-plus algebra, and the chosen steps as maps of states,
so the pieces of a long conversation are worked on apart, and only one small
row per piece meets the others.

Defined results: turns are taken by (turn, hash of role and text), null turns
first; a null or unknown role has to be relabelled; a null text is empty; a null
conversation id is a conversation; extra columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contagia.llm.common import stash
from contagia.sources.workspace import Workspace

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Legal next states.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
_FAR = 10**9


@dataclass(frozen=True)
class RepairCosts:
    merge: int = 1
    insert: int = 2
    relabel: int = 3


@dataclass(frozen=True)
class Template:
    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    merged: str = "\n"


@dataclass(frozen=True)
class Action:
    name: str
    to: int
    cost: int
    inserted: int | None = None


@cache
def actions(state: int, role: int, costs: RepairCosts) -> tuple[Action, ...]:
    """What can be done with a turn of `role` (0 for an unknown one), in order of preference."""
    out = []
    for to in (SYSTEM, USER, ASSISTANT):
        relabel = costs.relabel * (to != role)
        if to in NEXT[state]:
            out.append(Action("relabel" if relabel else "keep", to, relabel))
        if to == state:
            out.append(Action("merge+relabel" if relabel else "merge", to, costs.merge + relabel))
        for between in NEXT[state]:
            if to in NEXT[between]:
                out.append(Action("insert+relabel" if relabel else "insert", to, costs.insert + relabel, between))
    order = ["keep", "merge", "insert", "relabel", "merge+relabel", "insert+relabel"]
    return tuple(sorted(out, key=lambda a: order.index(a.name)))


def closing(state: int) -> tuple[int, ...]:
    """Empty turns that are still missing at the end."""
    return {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}[state]


def end_costs(costs: RepairCosts) -> tuple[int, ...]:
    return tuple(costs.insert * len(closing(s)) for s in range(4))


@cache
def _step(after: tuple[int, ...], role: int, costs: RepairCosts) -> tuple[tuple[int, ...], tuple[Action, ...]]:
    """Costs to go before a turn, from those after it, and the chosen action in each state."""
    chosen = tuple(min(actions(s, role, costs), key=lambda a: a.cost + after[a.to]) for s in range(4))
    return tuple(min(a.cost + after[a.to], _FAR) for a in chosen), chosen


def backward(roles: list[int], after: tuple[int, ...], costs: RepairCosts) -> tuple[tuple[int, ...], list[tuple[Action, ...]]]:
    policy, offset = [], 0
    for role in reversed(roles):
        after, chosen = _step(after, role, costs)
        policy.append(chosen)
        least = min(after)
        offset += least
        after = tuple(min(x - least, _FAR) for x in after)  # few different values, so steps are remembered
    return tuple(min(x + offset, _FAR) for x in after), policy[::-1]


def matrix(roles: list[int], costs: RepairCosts) -> list[tuple[int, ...]]:
    """Least costs from each state to each, as one column per end state."""
    return [backward(roles, tuple(0 if s == e else _FAR for s in range(4)), costs)[0] for e in range(4)]


def repair(roles: list[int], costs: RepairCosts = RepairCosts(), start: int = START, after: tuple[int, ...] | None = None) -> list[Action]:
    _, policy = backward(roles, end_costs(costs) if after is None else after, costs)
    out, state = [], start
    for chosen in policy:
        out.append(chosen[state])
        state = chosen[state].to
    return out


def render(texts: list[str], steps: list[Action], template: Template, first: bool, last: bool) -> list[str]:
    """Segments of the turns; they join to the conversation."""
    open_turn = lambda role: template.begin + ROLES[role - 1] + template.after_role
    out = []
    for text, step in zip(texts, steps):
        if step.name.startswith("merge"):
            out.append(template.merged + text)
            continue
        head = "" if first and not out else template.end
        if step.inserted is not None:
            head += open_turn(step.inserted) + template.end
        out.append(head + open_turn(step.to) + text)
    if last and out:
        out[-1] += template.end + "".join(open_turn(r) + template.end for r in closing(steps[-1].to))
    return out


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Pieces of conversations from rows sorted by (part, conv_id)."""
    held = None
    for batch in batches:
        frame = batch.select(columns).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        key = frame[["part", "conv_id"]].fillna(-1).astype("int64").to_numpy()
        null = frame["conv_id"].isna().to_numpy()
        new = (key[1:] != key[:-1]).any(axis=1) | (null[1:] != null[:-1])
        cuts = [0, *(new.nonzero()[0] + 1), len(frame)]
        for lo, hi in zip(cuts[:-2], cuts[1:-1]):
            run = frame.iloc[lo:hi]
            yield (run["part"].iloc[0], run["conv_id"].iloc[0]), run
        held = frame.iloc[cuts[-2]:]
    if held is not None and len(held):
        yield (held["part"].iloc[0], held["conv_id"].iloc[0]), held


def _in_parts(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part", "place")


def _rows(values: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*values)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array([None if x is pd.NA else x for x in c], t) for c, t in zip(columns, types)], names)


def _cut(turns: DataFrame, rows_per_part: int, workspace: Workspace) -> DataFrame:
    """The turns in order, stored, with the number of their part of the table."""
    code = F.coalesce(*(F.when(F.col("role") == r, i + 1) for i, r in enumerate(ROLES)), F.lit(0))
    tidy = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), code.alias("code"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64("role", "text").alias("tie"))
    n = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tidy.count() // rows_per_part))
    order = ("conv_id", "turn", "tie")
    placed = (tidy.repartitionByRange(n, *order).sortWithinPartitions(*order, "code", "text")
              .withColumn("part", F.spark_partition_id().cast("long")).withColumn("place", F.monotonically_increasing_id()))
    return stash(placed, workspace, "turns")


def _ends(placed: DataFrame, costs: RepairCosts) -> DataFrame:
    """For every piece of a conversation in several parts: its first state and the costs to go behind it."""
    parts = placed.groupBy("conv_id").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi")
    same = placed["conv_id"].eqNullSafe(F.col("_conv"))
    long = placed.join(parts.select(F.col("conv_id").alias("_conv")), same, "left_semi").select("part", "conv_id", "place", "code")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, conv), run in _runs(batches, ["part", "conv_id", "code"]):
            flat = [x for column in matrix(run["code"].tolist(), costs) for x in column]
            yield _rows([(part, conv, flat)], ["part", "conv_id", "m"], [pa.int64(), pa.int64(), pa.list_(pa.int64())])

    def behind(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("part", ascending=False)
        after, out = end_costs(costs), []
        for m in pieces["m"]:
            out.append(list(after))
            after = tuple(min(int(m[4 * e + s]) + after[e] for e in range(4)) for s in range(4))
        return pieces[["part", "conv_id"]].assign(after=out)

    def moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, conv), run in _runs(batches, ["part", "conv_id", "code", "after"]):
            after, to = tuple(int(x) for x in run["after"].iloc[0]), []
            for s in range(4):
                to.append(repair(run["code"].tolist(), costs, s, after)[-1].to)
            yield _rows([(part, conv, list(after), to)], ["part", "conv_id", "after", "to"],
                        [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())])

    def states(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces, state, out = pieces.sort_values("part"), START, []
        for to in pieces["to"]:
            out.append(state)
            state = int(to[state])
        return pieces[["part", "conv_id", "after"]].assign(start=out, last=[False] * (len(pieces) - 1) + [True])

    # One row per piece; a conversation has as many as the parts of the table it covers.
    m = _in_parts(long).mapInArrow(matrices, "part long, conv_id long, m array<long>")
    costs_behind = m.groupBy("conv_id").applyInPandas(behind, "part long, conv_id long, after array<long>")
    costs_behind = costs_behind.withColumnsRenamed({"part": "_part", "conv_id": "_conv"})
    met = long.join(costs_behind, (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv")))
    to = _in_parts(met.select("part", "conv_id", "place", "code", "after")).mapInArrow(moves, "part long, conv_id long, after array<long>, to array<int>")
    return to.groupBy("conv_id").applyInPandas(states, "part long, conv_id long, after array<long>, start int, last boolean")


def format_chats(turns: DataFrame, workspace: Workspace, costs: RepairCosts = RepairCosts(), template: Template = Template(),
                 rows_per_part: int = 200_000) -> DataFrame:
    """(conv_id, place, turn, role, action, inserted, cost, segment), one row per turn; segments join by place."""
    placed = _cut(turns, rows_per_part, workspace)
    ends = stash(_ends(placed, costs), workspace, "ends").withColumnsRenamed({"part": "_part", "conv_id": "_conv"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        names = ["conv_id", "place", "turn", "role", "action", "inserted", "cost", "segment"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
        for _, piece in _runs(batches, ["part", "conv_id", "place", "turn", "code", "text", "after", "start", "last"]):
            after = piece["after"].iloc[0]
            whole = after is None or after is pd.NA or isinstance(after, float)
            start = START if whole else int(piece["start"].iloc[0])
            last = True if whole else bool(piece["last"].iloc[0])
            steps = repair(piece["code"].tolist(), costs, start, None if whole else tuple(int(x) for x in after))
            parts = render(piece["text"].tolist(), steps, template, start == START, last)
            out += [(c, p, t, ROLES[s.to - 1], s.name, s.inserted and ROLES[s.inserted - 1], s.cost, x)
                    for c, p, t, s, x in zip(piece["conv_id"], piece["place"], piece["turn"], steps, parts)]
            if len(out) > 5000:
                yield _rows(out, names, types)
                out = []
        if out:
            yield _rows(out, names, types)

    same = (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv"))
    rows = placed.join(ends, same, "left").select("part", "conv_id", "place", "turn", "code", "text", "after", "start", "last")
    return _in_parts(rows).mapInArrow(
        run, "conv_id long, place long, turn long, role string, action string, inserted string, cost int, segment string")
