import random
from itertools import product

from contagia.llm import chat
from contagia.llm.chat import RepairCosts, Template

SCHEMA = "conv_id long, turn long, role string, text string, action string"


def legal(roles):
    body = roles[1:] if roles[:1] == ["system"] else roles
    return (not roles) or (bool(body) and body[-1] == "assistant" and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(body)))


def brute(roles, costs):
    """All repairs by enumeration: the least cost, then the first by the order of actions."""
    best = None

    def go(i, state, cost, names):
        nonlocal best
        if i == len(roles):
            total = cost + costs.insert * len(chat.closing(state))
            if best is None or (total, names) < best:
                best = (total, names)
            return
        for k, a in enumerate(chat.actions(state, roles[i], costs)):
            go(i + 1, a.to, cost + a.cost, names + [k])

    go(0, chat.START, 0, [])
    return best


def test_cheapest_repair_of_all_short_conversations():
    for costs in (RepairCosts(), RepairCosts(2, 1, 5), RepairCosts(3, 3, 1)):
        for n in range(1, 5):
            for roles in product(range(4), repeat=n):
                steps = chat.repair(list(roles), costs)
                total = sum(s.cost for s in steps) + costs.insert * len(chat.closing(steps[-1].to))
                want = brute(roles, costs)
                assert total == want[0]
                state, names = chat.START, []
                for r, s in zip(roles, steps):
                    names.append(chat.actions(state, r, costs).index(s))
                    state = s.to
                assert names == want[1]


def rendered_roles(text, t=Template()):
    return [x.split("\n", 1)[0] for x in text.split(t.begin)[1:]]


def conversations(seed, n, most=9):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        rows += [(c, k, rnd.choice(["system", "user", "assistant", "tool", None]), rnd.choice([f"t{k}", "", None]), "x") for k in range(rnd.randint(1, most))]
    return rows


def check(spark, rows, workspace, **options):
    got = {}
    for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA), workspace, **options).orderBy("place").collect():
        got.setdefault(r.conv_id, []).append(r)
    turns = {}
    for c, k, role, text, _ in rows:
        turns.setdefault(c, []).append((k, role, text or ""))
    assert got.keys() == turns.keys()
    for c, own in turns.items():
        own.sort(key=lambda x: x[0])
        codes = [chat.ROLES.index(r) + 1 if r in chat.ROLES else 0 for _, r, _ in own]
        steps = chat.repair(codes)
        assert [(r.turn, r.action, r.role) for r in got[c]] == [(k, s.name, chat.ROLES[s.to - 1]) for (k, _, _), s in zip(own, steps)]
        text = "".join(r.segment for r in got[c])
        assert text == "".join(chat.render([t for _, _, t in own], steps, Template(), True, True))
        assert legal(rendered_roles(text))


def test_table(spark, workspace):
    check(spark, conversations(1, 60) + [(None, 0, "user", "q", "x"), (None, 1, None, "w " * 20000, "x")], workspace)


def test_conversations_over_many_parts(spark, workspace):
    check(spark, conversations(2, 8) + [(100 + c, *r[1:]) for c in range(2) for r in conversations(3 + c, 1, 400)], workspace, rows_per_part=7)


def test_ties_repeated_rows_and_no_rows(spark, workspace):
    rows = [(1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (1, None, "system", "s", "x"), (1, 0, "assistant", "b", "x")]
    got = chat.format_chats(spark.createDataFrame(rows, SCHEMA), workspace).orderBy("place").collect()
    assert len(got) == 4 and got[0].role == "system" and legal(rendered_roles("".join(r.segment for r in got)))
    assert chat.format_chats(spark.createDataFrame([], SCHEMA), workspace.sub("none")).count() == 0
