import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from contagia.llm import quality
from contagia.llm.quality import QualityRules

SPACE = "[\x20\x09-\x0D]+"


def words_of(text):
    return [w for w in re.split(SPACE, text or "") if w]


def brute_rules(text):
    text, words = text or "", words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def bucket(parts, n):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed)
    return (seed - 2**64 if seed >= 2**63 else seed) % n


def grams(text, n):
    w = words_of(text)
    return [bucket([x], n) for x in w] + [bucket(p, n) for p in zip(w, w[1:])]


CASES = [
    None, "", "   \n\t\n", "one two", "a b c a b c a b c", "a a a a a", "x\ny\nx\n x\nx ", "## ** é😀 <b> | $5 &amp;",
    " ".join(f"w{i}" for i in range(60)), "the cat sat on the mat " * 12, "word " * 20000, "\x0b\x0cq\r\nq\r\nq",
    " ".join(f"w{i % 40}" for i in range(95)) + " a b c d e",
]


def test_rules(docs):
    frame = quality.rules(quality.with_words(docs([*CASES, *CASES], words="1", n_words="'x'")))
    got = frame.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert len(got) == 2 * len(CASES)
    for row in got:
        assert tuple(row)[1:] == brute_rules(CASES[row.doc_id % len(CASES)]), CASES[row.doc_id % len(CASES)]


@pytest.mark.parametrize("broadcast_ids", [0, 1_000_000])
def test_ratio_and_verdict(docs, spark, workspace, broadcast_ids):
    good, bad = "the quick brown fox jumps over lazy dogs " * 8, "zxq vvk qqp wwz kkj " * 12
    varied = " ".join(f"t{i}" for i in range(70))
    texts = [good + varied, good, bad, varied, None, good + "x", bad + varied]
    rule = QualityRules(buckets=64, threshold=0.05, broadcast_ids=broadcast_ids)
    trusted = spark.createDataFrame([(0,), (1,), (None,), (1,)], "doc_id long")
    got = {r.doc_id: r for r in quality.report(docs(texts), trusted, workspace, rule).collect()}
    raw, pos = np.full(64, 1.0), np.full(64, 1.0)
    for i, t in enumerate(texts):
        for b in grams(t, 64):
            raw[b] += 1
            pos[b] += i in (0, 1)
    ratio = np.log(pos / pos.sum()) - np.log(raw / raw.sum())
    for i, t in enumerate(texts):
        g = grams(t, 64)
        want = sum(ratio[b] for b in g) / max(len(g), 1)
        assert abs(got[i].score - want) < 1e-9
        assert got[i].kept == (not brute_rules(t)[-1] and want >= 0.05)


def test_no_trusted_documents_and_no_rows(docs, spark, workspace):
    none = spark.createDataFrame([], "doc_id long")
    rows = quality.report(docs(["a b", None]), none, workspace).collect()
    assert [r.score for r in rows] == [0.0, 0.0] and not any(r.kept for r in rows)
    assert quality.report(docs(["a"]).limit(0), none, workspace.sub("empty")).count() == 0


def test_plan_has_no_python(docs, spark, workspace):
    plan = quality.report(docs(["a b"]), spark.createDataFrame([(0,)], "doc_id long"), workspace)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_text_of_megabytes(docs):
    """Few and many repeated windows, in texts that are far longer than a task's share."""
    varied = " ".join(f"w{i}" for i in range(1_000_000))
    repeated = varied[:2_000_000] + " " + "same words again " * 300_000
    frame = quality.rules(quality.with_words(docs([varied, varied + " w1 w2 w3", repeated])))
    got = {r.doc_id: r.n_repeat_words for r in frame.select("doc_id", "n_repeat_words").collect()}
    assert got[0] == 0 and got[1] == 6 and got[2] == 900_000
