import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from contagia.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  two  spaces ", "x" * 3000, "a\nb\n\n c", "<|endoftext|> and <s> <0x41>", "mark ▁ here", "naïve café 漢字 🙂🙂   x",
       "tab\tand\x00nul", "it's we've 12345 !!!", "same text", "same text", "　wide", "é combining", "\r\n"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """Ids and bytes of both sides, or nothing."""
    a, b = libraries
    if not text:
        return [], []
    raw = (" " + text).encode()
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    e = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(back[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
    right = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    if any(b"".join(x for _, x in side) != raw for side in (left, right)):
        return [], []
    return left, right


def spans(side):
    at, out = 0, []
    for i, raw in side:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(libraries, texts):
    """All pairs of spans that overlap, groups from common ends, counts from all links."""
    docs, total = [], Counter()
    for text in texts:
        left, right = map(spans, tokens(libraries, text))
        links = [(x[0], y[0]) for x in left for y in right if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in left} & {y[2] for y in right})
        groups = [[",".join(str(x[0]) for x in side if lo < x[2] <= hi) for side in (left, right)] for lo, hi in zip([0, *cuts], cuts)]
        docs.append((len(left), len(right), links, groups))
        total.update(links)
    most = defaultdict(int)
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    return [(na, nb, len(groups), len(links), sum(total[x] == most[x[1]] for x in links), sum(total[x] for x in links),
             hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest() if groups else "") for na, nb, links, groups in docs]


def check(libraries, frame, texts, workspace, **options):
    got = {r[0]: tuple(r)[1:] for r in alignment.report(frame, A, B, workspace, **options).collect()}
    assert got == dict(enumerate(brute(libraries, texts)))


def test_odd_texts(docs, libraries, workspace):
    check(libraries, docs(ODD, n_a="7", links="'x'", chunk="3"), ODD, workspace)


def test_given_texts_and_small_dictionaries(docs, libraries, sample, workspace):
    texts = [t[:1500] for _, t in sample[:120]] + ODD
    check(libraries, docs(texts).repartition(3), texts, workspace, most_pairs=50)


def test_same_ids_as_the_library(libraries, sample):
    side = alignment.ByteLevel(open(A, encoding="utf-8").read())
    rnd = random.Random(5)
    noise = ["".join(rnd.choice("ab 's\n\t 　é漢🙂019.,-_") for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    texts = [t for _, t in sample] + [t for t in ODD if t] + noise
    ids, n = side.encode(texts)
    want = libraries[0].encode_batch([" " + t for t in texts], add_special_tokens=False)
    assert ids.tolist() == [i for e in want for i in e.ids] and n.tolist() == [len(e.ids) for e in want]


def test_merge_in_stretches_of_any_length():
    rnd = np.random.default_rng(3)
    sizes = [int(x) for x in rnd.integers(1, 400, 30)]
    sides = []
    for _ in range(2):
        ends, n, base = [], [], 0
        for size in sizes:
            own = np.unique(np.append(rnd.integers(1, size + 1, max(1, size // 3)), size))
            ends.append(own + base)
            n.append(len(own))
            base += size
        sides.append((np.concatenate(ends), np.array(n)))
    (ea, na), (eb, nb) = sides
    whole = alignment.merge(ea, eb, na, nb, 10**6)
    lo_a, lo_b = np.append(0, ea[:-1]), np.append(0, eb[:-1])
    want = [(i, j) for i in range(len(ea)) for j in range(len(eb)) if lo_a[i] < eb[j] and lo_b[j] < ea[i]]
    assert list(zip(*whole[:2])) == want and ea[whole[2]].tolist() == np.intersect1d(ea, eb).tolist() == eb[whole[3]].tolist()
    for stretch in (1, 2, 7, 50):
        assert all((x == y).all() for x, y in zip(whole, alignment.merge(ea, eb, na, nb, stretch)))


def test_pack():
    rnd = np.random.default_rng(1)
    for size in (0, 1, 50, 5000):
        numbers = rnd.zipf(1.3, size) % 3_000_000
        at, n = alignment.unpack(alignment.pack(numbers))
        assert dict(zip(at.tolist(), n.tolist())) == Counter(numbers.tolist())


def test_links_of_documents(docs, libraries):
    texts = ["hello tokenizers", "", "über alles"]
    for r in alignment.align(docs(texts), A, B).collect():
        left, right = map(spans, tokens(libraries, texts[r.doc_id]))
        assert r.ids_a == [x[0] for x in left] and r.ids_b == [x[0] for x in right]
        links = [(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x[1] < y[2] and y[1] < x[2]]
        assert list(zip(r.link_a, r.link_b)) == links
        assert r.cuts == sorted({x[2] for x in left} & {y[2] for y in right})


def test_null_ids_repeated_rows_no_rows(spark, docs, workspace):
    frame = docs([(None, "a b"), (None, "a b"), (4, None)])
    got = sorted(tuple(r)[1:6] for r in alignment.report(frame, A, B, workspace).collect())
    assert len(got) == 3 and got[0][0] == 0 and got[1] == got[2]
    assert alignment.report(docs(["x"]).limit(0), A, B, workspace.sub("none")).count() == 0
