import hashlib
import random

from contagia.llm import repeats


def brute(rows):
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            part = raw[p:p + 100]
            if part in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(part)
        runs = sum(1 for j in range(len(raw)) if gone[j] and (not j or not gone[j - 1]))
        out.append((len(raw), sum(gone), runs, bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def check(docs, rows, workspace):
    rows = sorted(rows)
    got = {r.doc_id: r for r in repeats.remove_repeats(docs(rows, packed="1", ord="2"), workspace).collect()}
    assert len(got) == len(rows)
    for (i, _), (n, removed, spans, kept) in zip(rows, brute(rows)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (n, removed, spans, kept), i
        assert len(r.starts) == spans and sum(r.lengths) == removed
    return sum(r.n_removed for r in got.values())


def make(n, seed, letters="abcdé "):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(50, 900))) for _ in range(20)]
    rows = []
    for i in range(n):
        text = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 6)):
            text[rnd.randrange(len(text))] = rnd.choice("xyz")
        rows.append((i * 7 % 1000, "".join(text) + rnd.choice(base)[:rnd.randint(0, 300)]))
    return rows


ODD = [(2000, "x" * 3000), (2001, "x" * 99), (2002, "ab" * 700), (2003, ""), (2004, None), (2005, "x" * 100), (2006, "abc" * 34),
       (2007, "Shti " * 400), (2008, "Shti " * 30)]


def test_against_brute_force(docs, workspace):
    assert check(docs, make(100, 1) + ODD, workspace) > 10000
    assert check(docs, make(60, 2, "ab"), workspace.sub("two")) > 5000


def test_parts_of_long_texts(docs, workspace, monkeypatch):
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(30000))
    monkeypatch.setattr(repeats, "_CHUNK", 4000)
    owner = [repeats._group_rows([long.encode()[at:at + 4099]]) for at in range(0, 30000, 4000)]
    assert sum(int(o[4].sum()) for o in owner) == 30000 - 99
    monkeypatch.undo()
    assert check(docs, [(1, long), (2, "q" + long), (3, long[500:20000] + "z" + long[:700])], workspace) > 49000


def test_texts_that_compress_well(docs, workspace, spark):
    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    unit, passages = text(4000), [text(600) for _ in range(7)]
    buckets = [[r.id for r in spark.range(100).where(f"pmod(hash(id), 4) = {k}").collect()] for k in (0, 1)]
    rows = [(i, unit * 200 + p) for i, p in zip(buckets[0], passages)]  # 5.6 MB in one bucket, a few KB when packed
    rows += [(i, "q" + p + "z") for i, p in zip(buckets[1], passages)]
    assert check(docs, rows, workspace) > 7 * 600 + 6 * 800_000


def test_sample(docs, workspace, sample):
    assert check(docs, sample, workspace) > 1000


def test_nulls_repeated_ids_and_no_rows(docs, workspace):
    text = "".join(hashlib.sha256(bytes([i])).hexdigest()[0] for i in range(150)) + "é" * 30
    frame = docs([(5, text), (5, text), (None, text), (7, text)])
    got = sorted((r.doc_id or -1, r.n_removed) for r in repeats.digests(repeats.remove_repeats(frame, workspace)).collect())
    assert got == [(-1, 0), (5, 210), (5, 210), (7, 210)]
    assert repeats.remove_repeats(frame.limit(0), workspace.sub("none")).count() == 0
    kept = repeats.digests(repeats.remove_repeats(docs([(1, "")]), workspace.sub("one"))).first()
    assert kept.kept_sha256 == hashlib.sha256(b"").hexdigest()
