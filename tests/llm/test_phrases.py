import hashlib
import random

import numpy as np
import pytest

from contagia.llm import phrases


def brute_levels(raw):
    """Symbols of every level, one by one, each with the bytes that it stands for."""
    mask = 2**64 - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    symbols = [(b, 1) for b in raw]
    level = 0
    while True:
        runs = []
        for s, n in symbols:
            if runs and runs[-1][0] == s:
                runs[-1] = s, runs[-1][1] + 1, runs[-1][2] + n
            else:
                runs.append((s, 1, n))
        label = [s for s, _, _ in runs]
        for _ in range(4):
            out = [label[0] & 1]
            for p, x in zip(label, label[1:]):
                bit = ((p ^ x) & -(p ^ x)).bit_length() - 1
                out.append(2 * bit + (x >> bit & 1))
            label = out
        assert max(label) < 6 and all(x != y for x, y in zip(label, label[1:]))
        cuts = [0] + [i for i in range(2, len(runs) - 1) if label[i - 1] < label[i] > label[i + 1]]
        symbols = []
        for lo, hi in zip(cuts, [*cuts[1:], len(runs)]):
            total = 0
            for k, (s, n, _) in enumerate(runs[lo:hi]):
                value = int(phrases._BYTE[s]) if level == 0 else s
                value = mix((value + n * int(phrases._RUN)) & mask) if n > 1 else value
                total += value * int(phrases._ODD[k])
            symbols.append((mix(total & mask), sum(n for _, _, n in runs[lo:hi])))
        level += 1
        yield symbols
        if len(symbols) == 1:
            return


def names_of(raws):
    out = [[] for _ in raws]
    for _, docs, sizes, names in phrases.parse(raws):
        for d, own in zip(docs, np.split(names, np.cumsum(sizes)[:-1])):
            out[d].append(own.tolist())
    return out


RND = random.Random(11)
TEXTS = ["", "a", "ab", "aaaa", "abab" * 50, "aaab" * 40, "x" * 5000, "ä漢🙂" * 30, "a\0b", "The quick brown fox. " * 20,
         *("".join(RND.choice("abc de") for _ in range(RND.randint(1, 300))) for _ in range(40))]


@pytest.mark.parametrize("block", [phrases.BLOCK, 16, 50])
def test_levels_by_brute_force(monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK", block)
    raws = [t.encode() for t in TEXTS]
    assert names_of(raws) == [[[s for s, _ in level] for level in brute_levels(r)] if r else [] for r in raws]


def test_equal_substrings_share_their_interior():
    inner = bytes(RND.choice(b"abcdefgh ,.") for _ in range(3000))
    placed = []
    for k in range(6):
        lead = bytes(RND.choice(b"xyz abc") for _ in range(RND.randint(0, 200)))
        tail = bytes(RND.choice(b"xyz abc") for _ in range(RND.randint(0, 200)))
        levels, whole = list(brute_levels(lead + inner + tail)), lead + inner + tail
        own = []
        for level in levels[:4]:
            at, spans = 0, set()
            for name, n in level:
                spans.add((at - len(lead), at - len(lead) + n, name))
                at += n
            own.append(spans)
        assert at == len(whole)
        placed.append(own)
    for level in range(4):
        margin = 40 * 4**level
        core = [{s for s in own[level] if s[0] >= margin and s[1] <= len(inner) - margin} for own in placed]
        assert all(c == core[0] for c in core) and (level > 2 or core[0])


def test_likeness_follows_what_texts_share():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    for shared in (0.0, 0.3, 0.6, 0.9, 1.0):
        pairs = []
        for _ in range(40):
            k = int(400 * shared)
            common = text(k)
            pairs.append((common + " " + text(400 - k), text(400 - k) + " " + common))
        a, b = (phrases.fingerprints([p[i] for p in pairs]) for i in (0, 1))
        found = phrases.likeness(a, b).mean()
        assert abs(found - shared / (2 - shared)) < 0.12, (shared, found)
    same = phrases.fingerprints(["one text", "one text", "", ""])
    assert (same[0] == same[1]).all() and not same[2].any() and phrases.likeness(same[:1], same[1:2])[0] == phrases.likeness(same[2:3], same[3:])[0] == 1
    assert phrases.likeness(same[:1], same[2:3])[0] == 0


def expected(rows):
    """rows of (id, text) in their order."""
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        k = len(t) // 3
        e = t[:len(t) - k] + after[:k]
        p = phrases.fingerprints([t, e, after])
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), p[0].tobytes().hex(), p[1].tobytes().hex(),
                    float(phrases.likeness(p[:1], p[1:2])[0]), float(phrases.likeness(p[:1], p[2:])[0])))
    return out


def key(row):
    return (row[0] is None, row[0] or 0, *map(str, row[1:]))


@pytest.mark.parametrize("part_bytes", [phrases.PART_BYTES, 3000])
def test_table(docs, sample, workspace, part_bytes):
    rows = sorted(sample[:150] + [(1_000_000 + i, t) for i, t in enumerate([*TEXTS, None, "tie"])], reverse=True, key=lambda r: r[0])
    frame = docs(rows, text_="'x'", part="1", head="true", fingerprint="'f'").repartition(5)
    got = phrases.report(frame, workspace, part_bytes)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(rows), key=key)


def test_null_and_repeated_ids_and_few_rows(docs, workspace):
    assert phrases.report(docs(["x"]).limit(0), workspace.sub("none")).count() == 0
    assert [tuple(r) for r in phrases.report(docs([(7, "abcdef")]), workspace.sub("one")).collect()] == expected([(7, "abcdef")])
    got = phrases.report(docs([(3, "aaa bbb"), (3, "aaa bbb"), (None, "q"), (None, None), (5, "five five")]), workspace.sub("few")).collect()
    assert len(got) == 5 and sum(r.doc_id is None for r in got) == 2
    twins = [r for r in got if r.doc_id == 3]
    assert twins[0].fingerprint == twins[1].fingerprint and {r.near_next for r in twins} >= {1.0}


def test_fingerprints_alone(docs):
    got = {r.doc_id: r.fingerprint for r in phrases.fingerprint(docs(TEXTS)).collect()}
    assert got == {i: p.tobytes().hex() for i, p in enumerate(phrases.fingerprints(TEXTS))}
