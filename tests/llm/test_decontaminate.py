import random
import time

import numpy as np
import pytest

import corpus_pipeline
from contagia.llm import decontaminate, queries
from contagia.llm import decontaminate as d
from contagia.llm.decontaminate import LeakParams


def sellers(window, text):
    """Least edits of the window against any part of the text."""
    row = list(range(len(window) + 1))
    best = row[-1]
    for c in text:
        before, row = row, [0]
        for i, w in enumerate(window):
            row.append(min(before[i] + (w != c), before[i + 1] + 1, row[i] + 1))
        best = min(best, row[-1])
    return best


def brute(texts, items, p):
    out = set()
    for i, item in enumerate(map(d.normalise, items)):
        if len(item) < p.min_chars:
            continue
        w = min(p.window, len(item))
        starts = {*range(0, len(item) - w + 1, p.stride), len(item) - w}
        for t, text in enumerate(texts):
            edits = min(sellers(item[s:s + w], d.normalise(text or "")) for s in starts)
            if edits <= p.budget(w):
                out.add((t, i, edits))
    return out


def cases(seed, p):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "and", "thé", *("".join(rnd.choice("abehnot") for _ in range(6)) for _ in range(3))])
    items = [" ".join(word() for _ in range(rnd.randint(6, 30))) for _ in range(6)] + ["short one", "", items_repeat := "of the and " * 12, items_repeat]
    texts = [None, "", "of the and " * 40]
    for _ in range(40):
        item = list(rnd.choice(items))
        lo = rnd.randrange(len(item) // 2 + 1)
        part = item[lo:lo + rnd.randint(p.window // 2, p.window * 3)]
        for _ in range(rnd.randrange(0, 2 * p.budget(p.window) + 2)):
            at = rnd.randrange(len(part) + 1)
            part[at:at + rnd.randrange(2)] = rnd.choice(["", "x", " "])
        pad = [" ".join(word() for _ in range(rnd.randint(0, 12))) for _ in range(2)]
        texts.append(pad[0] + rnd.choice([" ", "", "\n"]) + "".join(part).upper() + rnd.choice(["  ", ""]) + pad[1])
    return texts, items


def test_filter_loses_nothing():
    for seed in range(6):
        for p in (LeakParams(q=4, window=48, min_chars=20), LeakParams(q=5, window=60, stride=7, edit_percent=10)):
            texts, items = cases(seed, p)
            block = d.Block(list(enumerate(items)), p)
            got = {(t, block.ids[i], e) for t, i, e in block.find([t or "" for t in texts])}
            want = brute(texts, items, p)
            assert {x[:2] for x in got} == {x[:2] for x in want}
            found = {x[:2]: x[2] for x in want}
            assert all(e >= found[t, i] for t, i, e in got)


def test_blocks_nulls_repeats_and_no_rows(docs, spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"), (2, None), (None, "tiny")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    text = "x " + items[0][1].replace(" ", "\n") + " y"
    frame = docs([text, None, "clean words only", text, "w " * 40000 + text], item_id="5")
    for chars in (1, 1 << 20):
        rows = d.find(frame, bench, LeakParams(block_chars=chars)).collect()
        assert sorted(map(tuple, rows)) == [(0, 1, 0), (3, 1, 0), (4, 1, 0)]
        kept = d.drop_contaminated(frame, bench, LeakParams(block_chars=chars))
        assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert d.find(frame.limit(0), bench).count() == 0 and d.find(frame, bench.limit(0)).count() == 0
    assert d.drop_contaminated(frame, bench.limit(0)).count() == 5


def test_whole_passages_of_the_sample(docs, spark, sample):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r.item_id: d.normalise(r.text) for r in bench.collect()}
    got = {(r.doc_id, r.item_id) for r in d.find(docs(sample), bench).collect()}
    whole = {(i, k) for i, t in sample for k, b in items.items() if b in d.normalise(t)}
    assert whole and whole <= got
    for i, k in got - whole:  # the rest shares at least one window
        text, item, p = d.normalise(dict(sample)[i]), items[k], LeakParams()
        w = min(p.window, len(item))
        assert min(sellers(item[s:s + w], text) for s in {*range(0, len(item) - w + 1, p.stride), len(item) - w}) <= p.budget(w)


def test_short_items(docs, spark, tmp_path):
    items = ["Why?", "Who was Ada Lovelace?", "法国的首都是哪里", "name the largest moon of saturn", "  ", "is it"]
    texts = ["he asked: 'why?' and left", "Who  was\nAda Lovelace? x", "q who was ada lovelaxe? x", "who was grace hopper? x", "问法国的首都是哪里吗",
             "name the largest mon of saturm", "name the larger man of saturm", "this item", "Is it, then", None]
    want = {(0, 0, 0), (1, 1, 0), (2, 1, 1), (4, 2, 0), (5, 3, 2), (8, 5, 0)}
    for i, item in enumerate(map(d.normalise, items)):  # the same by brute force
        k = len(item) * 8 // 100
        for t, text in enumerate(texts):
            if k:
                edits = sellers(item, d.normalise(text or ""))
                assert ((t, i, edits) in want) == (edits <= k), (t, i, edits)
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.QUERIES["op9_decontaminate"](spark, str(tmp_path)).collect())) == sorted(want)
    assert {r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs(texts), str(tmp_path)).collect()} == set(range(10)) - {t for t, _, _ in want}


def test_items_under_the_first_q():
    rnd = random.Random(9)
    items = ["".join(rnd.choice("abc ") for _ in range(rnd.randint(14, 45))) for _ in range(25)]
    texts = []
    for _ in range(60):
        part = list(rnd.choice(items))
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(part) + 1)
            part[at:at + rnd.randrange(2)] = rnd.choice(["", "x"])
        texts.append("zz " + "".join(part) + " zz")
    got = {(t, b.ids[i]) for b in d._block(list(enumerate(items)), d.EVERY) for t, i, _ in b.find(texts) if isinstance(b, d.Block)}
    own = [(i, d.normalise(x)) for i, x in enumerate(items)]
    want = {(t, i) for i, x in own if len(x) >= 13 for t, text in enumerate(texts) if sellers(x, d.normalise(text)) <= len(x) * 8 // 100}
    assert got == want and len(want) > 30


def test_passages_between_strides(docs, spark, tmp_path):
    rnd = random.Random(4)
    item = "".join(rnd.choice("abcdefghijklm") for _ in range(300))
    parts = []
    for k, lo in enumerate((5, 13, 98, 196)):
        part = list(item[lo:lo + 100])
        for at in range(6, 6 + 11 * (8 + (k == 3)), 11):  # eight edits, and nine that are too many
            part[at] = "z"
        parts.append("y " + "".join(part) + " y")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs(parts).write.parquet(f"{tmp_path}/documents.parquet")
    best = [min(sellers(item[s:s + 100], t) for s in range(201)) for t in parts]
    want = [(k, 7, e) for k, e in enumerate(best) if e <= 8]
    assert sorted(map(tuple, queries.QUERIES["op9_decontaminate"](spark, str(tmp_path)).collect())) == want and len(want) == 3


@pytest.mark.parametrize("unit,other", [("=", "-"), ("ab", "ac"), ("-=- ", "-+- "), ("the same words again and again ", "other words here and not there ")])
def test_repeated_characters(unit, other):
    """Items and texts of one repeated unit, far longer than a window; the other unit is not found."""
    item = unit * (1000 // len(unit))
    (block,) = decontaminate._block([(1, item), (2, other * (600 // len(other))), (3, unit * (60 // len(unit)) + "qwertyuiop asdfghjkl zxcvbnm " * 9)], decontaminate.EVERY)
    begin = time.perf_counter()
    long = unit * (1_000_000 // len(unit))
    assert block.find([long, unit * (80 // len(unit)), "", long[:100_000]]) == [(0, 0, 0), (3, 0, 0)]
    assert time.perf_counter() - begin < 30


def test_progressions():
    rnd = np.random.default_rng(2)
    for _ in range(300):
        places = np.unique(rnd.integers(0, 30, rnd.integers(0, 25)))
        got = [s + step * i for s, step, n in decontaminate._progressions(places) for i in range(n)]
        assert sorted(got) == places.tolist()


def test_sums_of_progressions_equal_single_pairs(monkeypatch):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(["ab", "=", "==========", "a long unit of words "]) * rnd.randint(1, 40) for _ in range(4)) for _ in range(8)]
    items = [(i, t[rnd.randint(0, 40):][:300]) for i, t in enumerate(texts[:4])]
    found = []
    for listed in (0, 20, 1 << 40):
        monkeypatch.setattr(decontaminate, "_LISTED", listed)
        found.append([sorted(b.find(texts)) for b in decontaminate._block(items, decontaminate.EVERY)])
    assert found[0] == found[1] == found[2] and any(found[0])
