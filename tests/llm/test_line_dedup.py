import random
from fractions import Fraction

import corpus_pipeline
from contagia.llm import line_dedup, queries
from contagia.llm.line_dedup import LineParams


def brute(docs, least=5, threshold=Fraction(4, 5)):
    """Numbers of removed lines by row; `docs` in the order of their ids."""
    seen, out = [], []
    for _, text in docs:
        gone = []
        for j, line in enumerate((text or "").encode().lower().split(b"\n")):
            words = frozenset(line.split())
            if len(words) < least:
                continue
            if any(threshold <= Fraction(len(words & s), len(words | s)) for s in seen):
                gone.append(j)
            seen.append(words)
        out.append(gone)
    return out


def check(docs, rows, workspace, p=LineParams(), least=5):
    rows = sorted(rows)
    frame = docs(rows, h="1", lines="'x'")
    got = {r.doc_id: r for r in line_dedup.remove(frame, workspace, p).collect()}
    for (i, text), gone in zip(rows, brute(rows, least)):
        assert (got[i]._removed or []) == gone, (i, gone, got[i]._removed)
        kept = [x for j, x in enumerate((text or "").split("\n")) if j not in gone]
        assert got[i].text == ("\n".join(kept) if gone else text)
    return sum(len(r._removed or []) for r in got.values())


def make(n, seed, vocabulary=300, edits=4):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "and", "a", "to"]) if rnd.random() < 0.4 else f"w{rnd.randrange(vocabulary)}"
    base = [[word() for _ in range(rnd.randint(3, 40))] for _ in range(25)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rnd.randint(0, 6)):
            line = list(rnd.choice(base)) if rnd.random() < 0.7 else [word() for _ in range(rnd.randint(1, 30))]
            for _ in range(rnd.randrange(edits + 1)):
                line[rnd.randrange(len(line))] = word()
            lines.append(rnd.choice([" ", "  ", "\t"]).join(line))
        rows.append((i * 3 % 1000, "\n".join(lines)))
    return rows


def test_against_brute_force(docs, workspace):
    odd = [(2000, None), (2001, ""), (2002, "\n\n \n"), (2003, "a b c d e\nA B C D E\nb a c d e f\ne d c b a"),
           (2004, "x " * 30000 + "one two three four"), (2005, "one two three four x"), (2006, "a b\na b\na b")]
    assert check(docs, make(150, 1) + odd, workspace) > 50


def test_crowded_groups_and_second_round(docs, workspace):
    rows = make(120, 2, vocabulary=40, edits=6)
    for k, p in enumerate((LineParams(), LineParams(group_rows=4), LineParams(first_round=3), LineParams(count_bits=8, lone_bits=10, filter_bits=8, group_rows=20))):
        assert check(docs, rows, workspace.sub(f"p{k}"), p) > 50
    assert check(docs, rows, workspace.sub("all"), LineParams(min_tokens=1), least=1) > 50


def test_sample(docs, workspace, sample):
    check(docs, sample, workspace)


def test_nulls_repeated_rows_and_no_rows(docs, workspace):
    line = "one two three four five six"
    rows = [(None, line), (1, line), (1, line), (1, "other words are here in this line\n" + line), (2, "b\n" + line)]
    got = sorted((r.doc_id or -1, r.n_lines, r.n_removed) for r in line_dedup.report(docs(rows), workspace).collect())
    assert got == [(-1, 1, 0), (1, 1, 1), (1, 1, 1), (1, 2, 1), (2, 2, 1)]
    assert line_dedup.report(docs(rows).limit(0), workspace.sub("none")).count() == 0


def test_lines_of_few_words(docs, workspace, spark, tmp_path):
    rows = [(0, "les.\none two three four\nx x x\nsame"), (1, "Les.\nx\nfour three two one five\none two three\n\n \t"),
            (2, "les. les.\none two three\n一二三四五六七八九十\none two six four"), (3, "一二三四五六七八九十\none two\nthree one two\nsame\n\n"),
            (4, "p q r s t\np q r t"), (5, None)]
    gone = brute(rows, 1)
    assert gone == [[], [0, 1, 2], [0, 1], [0, 2, 3], [1], []]
    rows += [(10 + i, t) for i, t in make(80, 3, vocabulary=6, edits=1)]
    rows += [(2000 + i, " ".join(random.Random(i).sample("abcdef", random.Random(i).randint(1, 6)))) for i in range(150)]
    assert check(docs, rows, workspace, line_dedup.EVERY, least=1) > 100
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: len(g) for (i, _), g in zip(sorted(rows), brute(sorted(rows), 1))}
    assert {r.doc_id: r.n_removed for r in queries.QUERIES["op2_line_dedup"](spark, str(tmp_path)).collect()} == want
    left = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs(rows), str(tmp_path)).collect()}
    for (i, text), g in zip(sorted(rows), brute(sorted(rows), 1)):
        kept = "\n".join(x for j, x in enumerate((text or "").split("\n")) if j not in g)
        assert left.get(i, "") == (kept if g and kept.strip() else "" if g else text)


def test_equal_lines_of_texts_that_share_an_id(docs, workspace):
    head = "one two three four five six"
    for k, i in enumerate((None, 7)):
        rows = [(i, f"{head}\n{x}") for x in "ABC"] + [(i, f"{head}\nA")]
        got = {r.text: r._removed for r in line_dedup.remove(docs(rows), workspace.sub(f"k{k}"), line_dedup.EVERY).collect()}
        whole = [t for t, gone in got.items() if not gone]
        assert len(whole) == 1 and len(got) == 3 and sum(gone == [0] for gone in got.values()) == 2


def test_helper_columns_do_not_clash(docs, workspace):
    frame = docs(["one two three four five\nx", "one two three four five\ny", "z"], _key="7", _ord="8", _asked="true", _removed="'r'", _gone="'g'")
    got = {r.doc_id: r.asDict() for r in line_dedup.remove(frame, workspace, line_dedup.EVERY, removed_col="numbers").collect()}
    assert [got[i]["text"] for i in range(3)] == ["one two three four five\nx", "y", "z"] and [got[i]["numbers"] for i in range(3)] == [None, [0], None]
    assert all((r["_key"], r["_ord"], r["_asked"], r["_removed"], r["_gone"]) == (7, 8, True, "r", "g") for r in got.values())


def test_long_lines_that_share_words_are_hardly_candidates(docs, workspace, spark):
    rnd = random.Random(9)
    lines = [rnd.sample([f"w{i}" for i in range(400)], 150) for _ in range(120)]
    rows = [(i, " ".join(x)) for i, x in enumerate(lines)] + [(200 + i, " ".join([*lines[i][:140], "p", "q"])) for i in range(0, 120, 10)]
    assert check(docs, rows, workspace, line_dedup.EVERY, least=1) == 12
    assert 12 <= spark.read.parquet(workspace.child("pairs")).count() < 30


def test_words_of_very_many_lines_are_not_held(docs, workspace):
    rows = make(100, 5, vocabulary=30, edits=5)
    assert check(docs, rows, workspace, LineParams(group_rows=8, held_rows=16, narrow=6)) > 50
