import random
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from contagia.llm import toxicity as t
from contagia.llm.common import table


def brute_marginals(e, start, moves):
    """Log odds of the tags at every token by summing over all tag sequences."""
    n = len(e)
    weight = {}
    for tags in product((0, 1), repeat=n):
        x = start[tags[0]] + sum(moves[a, b] for a, b in zip(tags, tags[1:])) + sum(v for v, y in zip(e, tags) if y)
        weight[tags] = np.exp(x)
    return [np.log(sum(w for y, w in weight.items() if y[i])) - np.log(sum(w for y, w in weight.items() if not y[i])) for i in range(n)]


def test_forward_and_backward_match_all_sequences():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sizes = rng.integers(0, 7, 5)
        e, start, moves = rng.normal(size=int(sizes.sum())) * 3, rng.normal(size=2), rng.normal(size=(2, 2))
        got = t._forward(e, sizes, start, moves) + t._backward(e, sizes, moves)
        at = 0
        for n in sizes:
            if n:
                assert np.allclose(got[at:at + n], brute_marginals(e[at:at + n], start, moves))
            at += n


def corpus(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7))) for _ in range(rnd.randint(1, 60))]
        bad = rnd.random() < 0.2
        for _ in range(rnd.randint(1, 3) if bad else 0):
            words.insert(rnd.randrange(len(words) + 1), rnd.choice(["vile", "zorx" + rnd.choice("abc"), "VILE!!"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_held_out_accuracy_spans_and_label_blindness(spark, docs):
    rows = corpus(900, 1)
    frame = docs([r[:2] for r in rows], score="9", starts="1")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    tagger = t.fit(frame, labels.where(~t.held_out(F.col("doc_id"))))
    got = {r.doc_id: r for r in t.score(frame, tagger).collect()}
    held = {r.doc_id for r in labels.where(t.held_out(F.col("doc_id"))).collect()}
    right = [got[i].predicted == bad for i, _, bad in rows if i in held]
    assert len(right) > 100 and np.mean(right) > 0.97
    for i, text, bad in rows:
        words = [text[a:b] for a, b in zip(got[i].starts, got[i].ends)]
        if bad and i in held and got[i].predicted:
            assert words and np.mean([w.strip("!").lower()[:4] in ("vile", "zorx") for w in words]) == 1
    kept = t.keep_clean(frame, tagger)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    other = t.score(docs([(10**6 + i, x) for i, x, _ in rows[:50]]), tagger).collect()
    assert {r.doc_id - 10**6: r.score for r in other} == {i: got[i].score for i in range(50)}


def test_odd_texts_and_tables(spark, docs):
    rows = corpus(300, 2)
    labels = spark.createDataFrame([*((r[0], r[2]) for r in rows), (None, 1), (1, None)], "doc_id long, toxic int")
    tagger = t.fit(docs([r[:2] for r in rows]), labels)
    odd = docs([None, "", " \n\t", "é" * 3, "w " * 30000, "w " * 30000 + "vile", "vile", "vile"])
    got = {r.doc_id: r for r in t.score(odd, tagger).collect()}
    assert [got[i].predicted for i in range(8)] == [0, 0, 0, 0, 0, 1, 1, 1]
    assert got[0].score == got[1].score == got[2].score and got[6].score == got[7].score
    assert (got[5].starts, got[5].ends) == ([60000], [60004])
    assert t.score(odd.limit(0), tagger).count() == 0 and t.keep_clean(odd, tagger).count() == 5
    none = t.fit(docs([r[:2] for r in rows]), labels.limit(0))
    assert {r.score for r in t.score(odd, none).collect()} == {0.0} and t.keep_clean(odd, none).count() == 8


def test_sample_is_deterministic(spark):
    small = "/root/testdata/sf0.001"
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    one, two = (t.score(docs, t.fit(docs, labels)) for _ in range(2))
    assert sorted((r.doc_id, r.score) for r in one.collect()) == sorted((r.doc_id, r.score) for r in two.collect())
