import random
import re
from itertools import combinations

import xxhash

from contagia.llm import simhash
from contagia.llm.components import components


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {i: min(g) for g in groups.values() for i in g}


def test_masks_cover_every_four_positions():
    masks = simhash.covering_masks()
    assert len(masks) == 31 and min(m.bit_count() for m in masks) >= 30
    rnd = random.Random(3)
    sets = [rnd.sample(range(64), 4) for _ in range(20000)] + [list(c) for c in combinations(range(24), 4)]
    for s in sets:
        d = sum(1 << i for i in s)
        assert any(not m & d for m in masks)


def check(spark, docs, texts, workspace, **options):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(texts, fp="1"), workspace, **options).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(list(range(len(texts))), fps)
    for i, f in enumerate(fps):
        assert got[i].fingerprint == f"{f:016x}", texts[i]
    assert {i: r.component_id for i, r in got.items()} == want
    return want


def make_texts(n, seed, edits):
    rnd = random.Random(seed)
    base = [[rnd.choice("abcdefgh") + str(rnd.randrange(400)) for _ in range(90)] for _ in range(3)]
    out = []
    for _ in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.randrange(edits)):
            words[rnd.randrange(len(words))] = "n" + str(rnd.randrange(1000))
        out.append(" ".join(words))
    return out


def test_small_and_odd_texts(spark, docs, workspace):
    texts = [None, "", " \n", "one", "ONE", "One two", "ÀB c d e", "a b c d", "a b c d e", "é" * 30000 + " x y z q", "a b c d"]
    want = check(spark, docs, texts + make_texts(60, 1, 4), workspace)
    assert want[0] == want[1] == want[2] and want[3] == want[4] and want[7] == want[10]


def test_crowded_buckets_and_points_halfway(spark, docs, workspace):
    texts = make_texts(300, 2, 5)
    want = check(spark, docs, texts, workspace)
    assert max(list(want.values()).count(v) for v in set(want.values())) > 40
    for rows in (3, 20):
        assert check(spark, docs, texts, workspace.sub(f"rows{rows}"), bucket_rows=rows) == want


def test_sample(spark, docs, workspace, sample):
    check(spark, docs, [t for _, t in sample], workspace)


def test_one_document_of_each_group_stays(docs, workspace, sample):
    frame = docs([*sample, (None, "q w e r t"), (10**6, "q w e r t"), (10**6, "q w e r t")], fp="1", turn="2")
    kept = simhash.keep_one(frame, workspace)
    assert kept.columns == frame.columns
    ids = [i for i, _ in sample]
    component = brute_components(ids, [brute_fingerprint(t) for _, t in sample])
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*component.values(), 10**6})


def test_repeated_ids_nulls_and_no_rows(spark, docs, workspace):
    got = simhash.near_duplicates(docs([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (7, "zz yy")]), workspace).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, 5), (5, 5), (5, 5), (7, 7)]
    assert simhash.near_duplicates(docs(["a"]).limit(0), workspace.sub("none")).count() == 0


def test_components_of_chains_and_hubs(spark, workspace):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 50)] + [(200, 201), (201, 200), (300, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), workspace).collect()))
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 50)}, 201: 200}


def test_helper_columns_do_not_clash(docs, workspace):
    frame = docs(["one text of some words here", "one text of some words here", "another one"], _fp="7", _id="8", _turn="9")
    got = simhash.keep_one(frame, workspace).collect()
    assert sorted(r.doc_id for r in got) == [0, 2] and all((r["_fp"], r["_id"], r["_turn"]) == (7, 8, 9) for r in got)
