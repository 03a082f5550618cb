import hashlib
import re

from pyspark.sql import functions as F

from contagia.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def brute(text):
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 8]
    spans += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    spans += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 32]
    order = ["assign", "access", "hex"]
    return sorted(spans, key=lambda s: (s[1], order.index(s[0])))


def run(frame, workspace):
    return secrets.report(frame, F.col("source"), F.concat_ws("/", "source", "lang"), workspace)


HEX = "0123456789abcdef" * 3
MIXED = "Ab1" * 6 + "xYz9" * 5
CASES = [
    None, "", "token=abc", "secret=token:abcdefgh12 token=token=abcdefgh", f"x AKIA{'Z9' * 8} {HEX} é😀 API_KEY: 'abcdefghi'",
    "PassWord = \"longenough1\" passwd:short", f"hex {HEX}{HEX}", f"{MIXED} alone", f"token={MIXED}", "AKIA123 AKIA" + "A" * 12,
    "ſecret=abcdefghij toKen=abcdefghij", "a" * 31 + " " + "b" * 32, "word " * 20000 + f"token={HEX}",
    " ".join(f"token=value{i:05d}" for i in range(300)),
]


def test_base_spans(docs, workspace):
    frame = docs([*CASES, *CASES], n_hex="7L")
    for row in run(frame, workspace).collect():
        text = CASES[row.doc_id % len(CASES)]
        want = brute(text)
        named = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert row.base_sha256 == hashlib.sha256(named.encode()).hexdigest(), text
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == n for k, _, _ in want) for n in ("assign", "access", "hex")]
        assert not named or set(named.split(",")) <= set(row.spans.split(","))


def test_owner_specific_strings_are_added_and_copied_ones_are_not(docs, workspace):
    other = "Zz9" * 11
    rows = [(i, f"see {other} here", "en", f"s{i}") for i in range(5)] + [(9, f"only {MIXED} here", "en", "s1"), (10, f"token={HEX}", "en", "s1")]
    got = {r.doc_id: r for r in run(docs(rows), workspace).collect()}
    assert got[9].spans == f"mixed:5:{5 + len(MIXED)}" and got[9].n_live == 1
    assert all(got[i].spans == "" and got[i].n_live == 0 for i in range(5))
    assert got[10].spans.startswith("assign:0:") and "mixed" not in got[10].spans


def test_ownership_counts_distinct_owners_and_repositories(docs, workspace):
    rows = [(i, f"token={HEX}", "en" if i % 2 else "fr", f"s{i % 3}") for i in range(12)]
    found = secrets.candidates(secrets.scan(docs(rows), F.col("source"), F.concat_ws("/", "source", "lang"), workspace))
    counted = {tuple(r)[1:] for r in secrets.ownership(found).collect()}
    assert counted == {(3, 6)}


def test_repeated_rows_nulls_and_no_rows(docs, workspace, spark):
    rows = [(None, f"token={HEX}", None, None)] * 2 + [(1, f"token={HEX}", "en", "s")] * 2
    got = run(docs(rows), workspace).collect()
    assert len(got) == 4 and len({(r.n_assign, r.base_sha256) for r in got}) == 1
    assert run(docs([]).limit(0), workspace.sub("none")).count() == 0


def test_plan_has_no_python(docs, workspace):
    plan = run(docs(CASES), workspace)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
