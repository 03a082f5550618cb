import random

import numpy as np

from contagia.llm import wordhash
from contagia.llm.wordcache import WordCache, flat

BLANK = wordhash.blank_table(b" ")


def spelled(words):
    return flat([[ord(c) for c in w] if w != "none" else [] for w in words])


def run(cache, words):
    whole = " ".join(words).encode()
    starts, ends = wordhash.bounds(np.frombuffer(whole, np.uint8), BLANK)
    return cache.encode(whole, starts, ends)


def test_any_size_of_cache_gives_the_same_ids():
    rnd = random.Random(1)
    pool = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6))) for _ in range(400)] + ["none"]
    chunks = [[rnd.choice(pool) for _ in range(rnd.randint(0, 300))] for _ in range(60)]
    for entries in (1, 20, 300, 10**6):
        cache = WordCache(spelled, entries)
        for words in chunks:
            got, want = run(cache, words), spelled(words)
            assert all((a == b).all() and len(a) == len(b) for a, b in zip(got, want))


def test_known_words_are_not_encoded_again():
    asked = []
    cache = WordCache(lambda words: asked.extend(words) or spelled(words))
    for _ in range(3):
        run(cache, ["one", "two", "one", "three"])
    assert sorted(asked) == ["one", "three", "two"]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    plain = wordhash.hashes
    monkeypatch.setattr(wordhash, "hashes", lambda raw, s, e, which=0: plain(raw, s, e, 1) if which else plain(raw, s, e) % np.uint64(3))
    cache = WordCache(spelled)
    for words in (["a"], ["b"], ["c", "d", "e", "f"], ["a", "b", "c"], ["g"], ["a"]):
        got, want = run(cache, words), spelled(words)
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()
