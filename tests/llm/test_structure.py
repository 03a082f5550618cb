import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from contagia.llm import rolegrammar, structure
from contagia.llm.rolegrammar import Grammar

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile("(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


def brute(turns):
    """Least (cost, edits, roles) of all edits with at most two insertions in one place; turns are (initial, gone, late)."""
    inserts = [p for n in range(3) for p in product("ua", repeat=n)]
    options = []
    for initial, gone, late in turns:
        own = [(3, "D", "")]
        if not gone:
            own += [(late, "K", initial), (2 + late, "R", "u"), (2 + late, "R", "a")]
        options.append([(2 * len(p) + c, "I" * len(p) + e, "".join(p) + r) for p in inserts for c, e, r in own])
    options.append([(2 * len(p), "I" * len(p), "".join(p)) for p in inserts])
    best = None
    for steps in product(*options):
        if LEGAL.fullmatch("".join(s[2] for s in steps)):
            found = sum(s[0] for s in steps), "".join(s[1] for s in steps)
            best = min(best or found, found)
    return best


def step_by_step(turns):
    """The same by keeping the least (cost, edits) for every kind of beginning."""
    kinds = {"": (0, "")}
    kind = lambda roles: roles if len(roles) < 2 else ("s" if roles[0] == "s" else "") + ("ua" if roles[-1] == "a" else "uau")

    def ok(roles):
        return any(LEGAL.fullmatch(roles + x) for x in ("", "a", "ua"))

    def grown(kinds):
        out = dict(kinds)
        for _ in range(2):
            for k, (c, e) in list(out.items()):
                for r in "ua":
                    if ok(k + r):
                        n = kind(k + r)
                        out[n] = min(out.get(n, (10**9, "")), (c + 2, e + "I"))
        return out

    for initial, gone, late in turns:
        after = {}
        for k, (c, e) in grown(kinds).items():
            for cost, edit, r in [(3, "D", "")] + ([] if gone else [(late, "K", initial), (2 + late, "R", "u"), (2 + late, "R", "a")]):
                if ok(k + r):
                    n = kind(k + r)
                    after[n] = min(after.get(n, (10**9, "")), (c + cost, e + edit))
        kinds = after
    return min(v for k, v in grown(kinds).items() if LEGAL.fullmatch(k))


def symbols(turns):
    return bytes(rolegrammar.GONE if gone else rolegrammar.symbol(" sua".index(i), late) for i, gone, late in turns)


KINDS = [(" ", True, 0), *((i, False, late) for i in "sua " for late in (0, 1))]


def answers(many):
    g = Grammar([symbols(t) for t in many])
    out = []
    for root in g.root:
        end = g.best_end(root)
        tail = rolegrammar.closing(end)
        out.append(((int(g.cost[root, 0, end]) if root >= 0 else 0) + 2 * len(tail), g.edits(root, 0, end) + tail))
    return out


def test_all_short_sequences():
    many = [list(x) for n in (0, 1, 2) for x in product(KINDS, repeat=n)]
    rnd = random.Random(1)
    many += [[rnd.choice(KINDS) for _ in range(3)] for _ in range(12)]
    assert answers(many) == [brute(t) for t in many] == [step_by_step(t) for t in many]


def test_long_and_repetitive_sequences_share_one_grammar():
    rnd = random.Random(2)
    many = [[rnd.choice(KINDS) for _ in range(rnd.randint(3, 60))] for _ in range(300)]
    many += [[("u", False, 0), ("a", False, 0)] * n for n in (1, 5, 64, 1000)] + [[("a", False, 1)] * 777, [KINDS[0]] * 500, many[0] * 7]
    g = Grammar([symbols(t) for t in many])
    assert answers(many) == [step_by_step(t) for t in many]
    assert len(g.cost) < sum(map(len, many)) / 3


def test_same_answers_in_any_company():
    rnd = random.Random(3)
    many = [[rnd.choice(KINDS) for _ in range(rnd.randint(1, 12))] for _ in range(50)]
    assert answers(many) == [answers([t])[0] for t in many]


def damaged(rows):
    blank = lambda x: " " if x is None else str(x)
    for c, k, role, text in rows:
        fault = zlib.crc32(f"{blank(c)}:{blank(k)}".encode()) % 20
        role, text = blank(role), blank(text)
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            yield from [(c, k, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)


def expected(rows, originals):
    """By conversation, from the turns after damage."""
    out = []
    for c in {r[0] for r in originals}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, counts, turns = set(), [0, 0, 0], []
        for _, _, role, text in own:
            body = text.rstrip(BLANK)
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                counts[fault] += 1
            initial = role[:1] if role[:1] in tuple("sua") else " "
            turns.append((initial, fault < 2, int(fault == 2)))
        numbers = [r[1] for r in own if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = step_by_step(turns)
        lines, state, left = [], "", list(own)
        for edit in audit:
            spoken = "assistant" if state == "u" else "user"
            if edit == "I":
                lines.append(spoken + ":")
                state = spoken[0]
                continue
            _, _, role, text = left.pop(0)
            if edit != "D":
                role = spoken if edit == "R" else role
                lines.append(f"{role}:{text}")
                state = role[0]
        out.append((c, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def generated(seed, n, most=9):
    rnd = random.Random(seed)
    texts = ["Yes.", "Sure!", "no end", "", " \t", None, "What?  ", "a\nb.", "x" * 3000 + "."]
    return [(c, k if rnd.random() < 0.95 else None, rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]),
             rnd.choice([*texts, f"Turn {k}.", f"Turn {k}?"])) for c in range(n) for k in range(rnd.randint(1, most))]


@pytest.fixture
def check(spark, workspace):
    def run(rows, damage=False, extra=(), **options):
        frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS audit", "1 AS part", "'c' AS conv", "0 AS place").repartition(3)
        turns = structure.damage(frame) if damage else frame
        originals = spark.createDataFrame([*rows, *extra], SCHEMA)
        got = structure.report(turns, originals, workspace.fresh("run"), **options)
        after = list(damaged(rows)) if damage else [tuple(" " if x is None and i > 1 else x for i, x in enumerate(r)) for r in rows]
        assert sorted(map(tuple, got.collect()), key=str) == expected(after, [*rows, *extra])
    return run


def test_table_with_damage(check):
    check(generated(1, 150) + [(None, k, "user", f"n{k}.") for k in range(5)] + [(None, 1, "assistant", "n1.")], damage=True)


def test_conversations_over_many_parts(check):
    check(generated(2, 12) + [(100 + c, *r[1:]) for c in range(3) for r in generated(5 + c, 1, 300)], rows_per_part=7)


def test_given_conversations(spark, check):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(rows, damage=True)
    check(rows, damage=True, rows_per_part=3)


def test_no_rows_left_and_no_rows(spark, check, workspace):
    check([(1, 0, "user", "a.")], extra=[(2, 0, "user", "b"), (None, 0, "user", "b")])
    none = spark.createDataFrame([], SCHEMA)
    assert structure.report(structure.damage(none), none, workspace.sub("none")).count() == 0


def test_repaired_turns(spark, workspace):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (2, 0, "system", "Be kind.")]
    got = structure.repair(spark.createDataFrame(rows, SCHEMA), workspace).orderBy("conv", "part", "place", "step").collect()
    assert [(r.conv, r.edit, r.role, r.text) for r in got] == [
        ("=1", "I", "user", ""), ("=1", "K", "assistant", "Hello."), ("=1", "K", "user", "Hi."), ("=1", "I", "assistant", "")]
