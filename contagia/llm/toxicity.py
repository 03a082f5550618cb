"""Toxic spans by a linear-chain conditional random field with two tags.

Labels are given per document, so tokens are labelled first: from training
documents, the word or word beginning that tells most toxic documents not
explained so far, and hardly any clean one, is taken as a sign, again and
again; tokens that carry a sign in toxic documents are tagged toxic, all tokens
of clean documents clean. The field is then fitted on those token labels, by
gradient ascent with forward-backward expectations. Its features are the word,
its beginnings and its ending, hashed, and the tag before.

A document is aggregated to the log odds of its most toxic token marginal
(the probability of any toxic tag would grow with the length of a clean text),
mapped through a logistic curve fitted on the training documents. Offending
offsets are the tokens whose marginal is over one half. Labels, language, source and id are never inputs of a score.

Fitting uses a bounded sample of the labelled documents: the `max_documents`
with the smallest hash of their id, of at most `max_chars` characters each. It
runs on the driver, within that bound. Scoring covers every whole text.

Defined results: a null text counts as empty and an empty text has no token, so
its score is that of no sign at all; repeated rows are scored each on their
own; without a toxic training document all scores are 0; extra columns are left
behind by `score` and kept by `keep_clean`.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contagia.llm.common import ragged, text_chunks, whole_text

TOKEN = re.compile("[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'()[]{}<>#*$%&|-_/\\«»„“”…"
_CACHE_WORDS = 400_000
_SIGN_BITS = 22
#: Log odds of a text without tokens.
_LEAST = -30.0


@dataclass(frozen=True)
class ToxicityParams:
    max_documents: int = 2_500
    max_chars: int = 20_000
    #: A sign tells at least this many unexplained toxic documents, and this share of them all.
    min_documents: int = 4
    min_share: float = 0.004
    precision: float = 0.9
    #: A feature of this share of the toxic documents is a sign even if others explain them.
    common_share: float = 0.06
    hash_bits: int = 18
    rounds: int = 40
    rate: float = 0.5
    decay: float = 1e-5


def _features(word: str) -> list[str]:
    bare = word.lower().strip(_EDGE)
    return ["w" + bare, *("p" + bare[:n] for n in range(2, min(len(bare), 8) + 1)), "s" + bare[-3:]]


def _hashed(word: str, bits: int) -> list[int]:
    return [zlib.crc32(f.encode()) >> (32 - bits) for f in _features(word)]


def _forward(e: np.ndarray, sizes: np.ndarray, start: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log odds of the tags at every token, given the tokens up to it. Texts advance together."""
    firsts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    left, at = sizes[order], firsts[order]
    flat = np.zeros(len(e))
    live = int((sizes > 0).sum())
    r = start[1] - start[0] + e[at[:live]]
    step = 0
    while live:
        flat[at[:live] + step] = r
        step += 1
        live = int(np.searchsorted(-left, -step, side="left"))  # texts longer than `step`
        r = r[:live]
        r = np.logaddexp(t[0, 1], r + t[1, 1]) - np.logaddexp(t[0, 0], r + t[1, 0]) + e[at[:live] + step]
    return flat


def _backward(e: np.ndarray, sizes: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log odds of what follows, at every token."""
    lasts = np.cumsum(sizes) - 1
    order = np.argsort(-sizes, kind="stable")
    left, at = sizes[order], lasts[order]
    flat = np.zeros(len(e))
    live = int((sizes > 1).sum())
    q = np.zeros(live)
    step = 0
    while live:
        x = e[at[:live] - step] + q
        q = np.logaddexp(t[1, 0], t[1, 1] + x) - np.logaddexp(t[0, 0], t[0, 1] + x)
        step += 1
        flat[at[:live] - step] = q
        live = int(np.searchsorted(-left, -(step + 1), side="left"))
        q = q[:live]
    return flat


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class Tagger:
    """A fitted field; emissions of words are kept for the worker's later batches."""

    def __init__(self, weights: np.ndarray, start: np.ndarray, moves: np.ndarray, slope: float, shift: float, empty: bool = False) -> None:
        self.weights, self.start, self.moves, self.slope, self.shift, self.empty = weights, start, moves, slope, shift, empty
        self._bits = int(np.log2(len(weights)))
        self._known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}

    def emissions(self, texts: list[list[str]]) -> np.ndarray:
        wanted = set().union(*texts)
        missing = [w for w in wanted if w not in self._known]
        if len(self._known) + len(missing) > _CACHE_WORDS:
            self._known, missing = {}, list(wanted)
        rows = [_hashed(w, self._bits) for w in missing]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        if len(rows):
            gathered = self.weights[np.fromiter((i for r in rows for i in r), np.int64, int(sizes.sum()))]
            self._known.update(zip(missing, np.add.reduceat(gathered, np.cumsum(sizes) - sizes).tolist()))
        get = self._known.__getitem__
        return np.fromiter((get(w) for words in texts for w in words), np.float64, sum(map(len, texts)))

    def odds(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log odds of the toxic tag at every token."""
        return _forward(e, sizes, self.start, self.moves) + _backward(e, sizes, self.moves)

    def score_of(self, odds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * _highest(odds, sizes) + self.shift)

    def tag(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the texts, log odds of their tokens, and the number of tokens of each."""
        tokens = [TOKEN.findall(t) for t in texts]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        if self.empty:
            return np.zeros(len(texts)), np.full(int(sizes.sum()), _LEAST), sizes
        odds = self.odds(self.emissions(tokens), sizes)
        return self.score_of(odds, sizes), odds, sizes


def toxic_spans(text: str, odds: np.ndarray) -> list[tuple[int, int]]:
    """Code point offsets of the tokens that are toxic by their marginal."""
    return [m.span() for m, x in zip(TOKEN.finditer(text), odds) if x > 0]


def _highest(odds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.full(len(sizes), _LEAST)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.clip(np.maximum.reduceat(odds, (np.cumsum(sizes) - sizes)[some]), _LEAST, -_LEAST)
    return out


def _sign_ids(word: str) -> list[int]:
    """Hashed ids of a word and of its beginnings of three letters and more."""
    return sorted({zlib.crc32(f.encode()) >> (32 - _SIGN_BITS) for f in _features(word) if f[0] != "s" and len(f) > 3})


def _signs(documents: list[np.ndarray], toxic: np.ndarray, params: ToxicityParams) -> np.ndarray:
    """Greedy cover of the toxic documents by words and word beginnings, as a mask over
    sign ids. A document is the sorted array of its sign ids."""
    def counted(some: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(1 << _SIGN_BITS, np.int32)
        for ids in some:
            out[ids] += 1
        return out

    open_ = [d for d, bad in zip(documents, toxic) if bad]
    clean, counts = counted([d for d, bad in zip(documents, toxic) if not bad]), counted(open_)
    whole, total = counts.copy(), len(open_)
    precise = whole >= params.precision * (whole + clean)
    least = max(params.min_documents, params.min_share * total)
    # Words that stand beside signs explain nothing more, but are as telling where they are common.
    found = precise & (whole >= max(params.min_documents + 1, params.common_share * total))
    while True:
        best = int(np.argmax(np.where(precise, counts - clean / (clean + 1.0), 0)))
        if not precise[best] or counts[best] < least:
            return found
        found[best] = True
        told = [best in d[np.searchsorted(d, best):][:1] for d in open_]
        counts -= counted([d for d, t in zip(open_, told) if t])
        open_ = [d for d, t in zip(open_, told) if not t]


def _packed(of: Callable[[str], list[int]], words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, one after the other, and how many each word has."""
    flat, sizes = array("i"), array("i")
    for word in words:
        own = of(word)
        flat.extend(own)
        sizes.append(len(own))
    return np.array(flat, np.int32), np.array(sizes, np.int64)


def _train(texts: list[str], toxic: np.ndarray, params: ToxicityParams) -> Tagger:
    index: dict[str, int] = {}
    ids = [np.array([index.setdefault(w, len(index)) for w in TOKEN.findall(t)], np.int64) for t in texts]
    vocabulary = list(index)
    flat, n_own = _packed(_sign_ids, vocabulary)
    ends = np.cumsum(n_own)
    starts = ends - n_own

    def signs_of(words: np.ndarray) -> np.ndarray:
        n = (ends - starts)[words]
        return np.unique(flat[np.repeat(starts[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())])

    signs = _signs([signs_of(np.unique(ws)) for ws in ids], toxic, params)
    told = np.add.reduceat(np.append(signs[flat], False).astype(np.int32), starts)  # one more, as a last word may have none
    signed = (told > 0) & (n_own > 0)
    columns, widths = _packed(lambda w: _hashed(w, params.hash_bits), vocabulary)
    cuts, owner = np.cumsum(widths) - widths, np.repeat(np.arange(len(widths), dtype=np.int32), widths)

    used = [i for i, ws in enumerate(ids) if len(ws) and (not toxic[i] or signed[ws].any())]
    word, sizes = np.concatenate([ids[i] for i in used]), np.array([len(ids[i]) for i in used], np.int64)
    tag = np.concatenate([signed[ids[i]] if toxic[i] else np.zeros(len(ids[i]), bool) for i in used])
    firsts = np.cumsum(sizes) - sizes
    inner = np.ones(len(word), bool)
    inner[firsts] = False
    before = np.flatnonzero(inner) - 1
    seen = np.zeros((2, 2))
    np.add.at(seen, (tag[before].astype(int), tag[before + 1].astype(int)), 1)

    n_words = len(vocabulary)
    weights, start, moves = np.zeros(1 << params.hash_bits), np.zeros(2), np.zeros((2, 2))
    squares = [np.full(x.shape, 1e-8) for x in (weights, start, moves)]
    for _ in range(params.rounds):
        e = np.add.reduceat(weights[columns], cuts)[word]
        ahead = _forward(e, sizes, start, moves)
        behind = _backward(e, sizes, moves)
        p = _sigmoid(ahead + behind)
        # Pairs of tags: odds of each given the messages on both sides.
        x = e[before + 1] + behind[before + 1]
        pair = np.empty((4, len(before)), np.float32)
        pair[0], pair[1] = moves[0, 0], moves[0, 1] + x
        pair[2], pair[3] = ahead[before] + moves[1, 0], ahead[before] + moves[1, 1] + x
        pair -= pair.max(axis=0)
        np.exp(pair, out=pair)
        pair /= pair.sum(axis=0)
        expected = pair.sum(axis=1, dtype=np.float64).reshape(2, 2)
        push = np.bincount(word, tag - p, n_words)
        steps = [np.bincount(columns, push[owner], len(weights)) - params.decay * weights,
                 np.array([0.0, (tag[firsts] - p[firsts]).sum()]), seen - expected]
        for value, gain, square in zip((weights, start, moves), steps, squares):
            square += gain * gain
            value += params.rate * gain / np.sqrt(square)
    tagger = Tagger(weights.astype(np.float32), start, moves, 1.0, 0.0)

    # The logistic curve: two numbers, fitted by Newton steps on all training documents.
    e = np.add.reduceat(weights[columns], cuts)
    every = np.array([len(i) for i in ids], np.int64)
    evidence = _highest(tagger.odds(e[np.concatenate(ids)], every), every) / 10
    x = np.stack([evidence, np.ones_like(evidence)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(30):
        p = _sigmoid(x @ beta)
        gain = x.T @ (toxic - p) - 0.01 * beta
        beta += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.01 * np.eye(2), gain)
    tagger.slope, tagger.shift = float(max(beta[0], 0.0)) / 10, float(beta[1])
    return tagger


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> Tagger:
    """Fit on `labels` (doc_id, toxic); the caller leaves out what is held out."""
    ids = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.max_documents))
    text = whole_text(docs).where(F.length("text") <= params.max_chars)
    rows = text.join(F.broadcast(ids), "doc_id").groupBy("text").agg(F.max("_toxic").alias("toxic")).orderBy("text").toArrow()
    toxic, texts = rows["toxic"].to_numpy() == 1, rows["text"].to_pylist()
    if not toxic.any() or not any(t.strip() for t in texts):
        return Tagger(np.zeros(2, np.float32), np.zeros(2), np.zeros((2, 2)), 1.0, 0.0, empty=True)
    return _train(texts, toxic, params)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """(doc_id, score, predicted, starts, ends) with the offsets of toxic tokens of predicted documents."""
    model = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            texts = batch.column("text").to_pylist()
            scores, odds, sizes = model.value.tag(texts)
            ends = np.cumsum(sizes)
            spans = [toxic_spans(t, odds[hi - n:hi]) if s >= 0.5 else [] for t, s, n, hi in zip(texts, scores, sizes, ends)]
            n = np.array([len(s) for s in spans], np.int64)
            flat = np.array([x for s in spans for x in s], np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)),
                 ragged(flat[:, 0], n, pa.int32()), ragged(flat[:, 1], n, pa.int32())], ["doc_id", "score", "predicted", "starts", "ends"])

    return whole_text(docs).mapInArrow(run, "doc_id long, score double, predicted int, starts array<int>, ends array<int>")


def keep_clean(docs: DataFrame, tagger: Tagger, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is not predicted to be toxic."""
    model = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text_col):
            scores = model.value.tag([t or "" for t in batch.column(text_col).to_pylist()])[0]
            yield batch.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(run, docs.schema)
