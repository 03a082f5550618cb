"""SentencePiece encoding that keeps source offsets, and decoding.

A text is normalised by longest-prefix replacement through the compiled
character map of the model. The normaliser records, for every normalised byte,
the source byte it came from, so every piece can be projected to the span of
original UTF-8 bytes that it stands for. Pieces come from the sentencepiece
library; models are never trained here.

Defined results: a null text counts as empty, an empty text has no pieces,
repeated rows are encoded each on their own, columns other than the id and the
text are left behind. A piece that stands for the added leading space alone
has an empty span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contagia.llm import wordhash
from contagia.llm.common import ragged, sha256, text_chunks, whole_text
from contagia.llm.wordcache import WordCache, flat

_SPACE = "▁".encode()
_BLANK = wordhash.blank_table(b" ")
ENCODED = "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string"


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, message[at:at + size]
            at += size


class CharacterMap:
    """The compiled character map: a double-array trie and its replacements."""

    def __init__(self, blob: bytes) -> None:
        self.empty = len(blob) <= 4
        size = int.from_bytes(blob[:4], "little") if not self.empty else 0
        self._units = np.frombuffer(blob[4:4 + size], "<u4").tolist() if size else []
        self._texts = blob[4 + size:]

    def longest_prefix(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes of the longest key that starts at `at`, and its replacement."""
        found, unit, node = None, self._units[0] if self._units else 0, 0
        if not self._units:
            return None
        node ^= _step(unit)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self._units):
                break
            unit = self._units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= _step(unit)
            if unit >> 8 & 1:
                start = self._units[node] & 0x7FFFFFFF
                found = i + 1 - at, self._texts[start:self._texts.index(b"\0", start)]
        return found


def _step(unit: int) -> int:
    return unit >> 10 << ((unit & 512) >> 6)


class Normaliser:
    def __init__(self, charsmap: bytes, dummy_prefix: bool, squeeze: bool, escape: bool) -> None:
        self.map = CharacterMap(charsmap)
        self.dummy_prefix, self.squeeze = dummy_prefix, squeeze
        self.space = _SPACE if escape else b" "

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and the end, the source offset."""
        if not text:
            return b"", np.zeros(1, np.int32)
        if self.map.empty and not self.squeeze:
            return self._plain(text)
        units: list[tuple[bytes, int]] = []
        at = 0
        while at < len(text):
            hit = self.map.longest_prefix(text, at)
            lead = text[at]
            step = hit[0] if hit else 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            units.append((hit[1] if hit else text[at:at + step], at))
            at += step
        pairs = [(byte, start) for piece, start in units for byte in piece]
        if self.squeeze:
            pairs = [p for i, p in enumerate(pairs) if p[0] != 32 or (i and pairs[i - 1][0] != 32)]
            while pairs and pairs[-1][0] == 32:
                pairs.pop()
        end = len(text) if not self.squeeze else len(text.rstrip(b" "))
        out, align = bytearray(), []
        if self.dummy_prefix and pairs:
            out += self.space
            align += [pairs[0][1]] * len(self.space)
        for byte, start in pairs:
            piece = self.space if byte == 32 else bytes([byte])
            out += piece
            align += [start] * len(piece)
        return bytes(out), np.array([*align, end], np.int32)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        width = np.where(np.frombuffer(text, np.uint8) == 32, len(self.space), 1)
        align = np.repeat(np.arange(len(text), dtype=np.int32), width)
        lead = len(self.space) if self.dummy_prefix else 0
        align = np.concatenate([np.zeros(lead, np.int32), align, np.array([len(text)], np.int32)])
        return (self.space if lead else b"") + text.replace(b" ", self.space), align


class Codec:
    """A model with its normaliser; one per Python worker and model file."""

    _open: dict[bytes, Codec] = {}

    def __init__(self, model: bytes) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec: dict[int, int | bytes] = {}
        for number, value in _fields(model):
            if number == 3:
                spec = dict(_fields(value))
        self.normalise = Normaliser(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))
        n = self.processor.get_piece_size()
        pieces = [self.processor.id_to_piece(i) for i in range(n)]
        self.width = np.array([1 if self.processor.is_byte(i) else len(p.encode()) for i, p in enumerate(pieces)], np.int64)
        # Parts between single spaces are encoded alone only where no piece can reach across a space.
        self._by_parts = (self.normalise.map.empty and self.normalise.dummy_prefix and not self.normalise.squeeze
                          and all("▁" not in p.lstrip("▁") for p in pieces))
        self._cache = WordCache(lambda words: flat(self.processor.encode(words, num_threads=1)), 600_000)

    @classmethod
    def of(cls, model: bytes) -> Codec:
        if model not in cls._open:
            cls._open[model] = cls(model)
        return cls._open[model]

    def _simple(self, text: str) -> bool:
        """Whether the text is its words with single spaces between them."""
        return self._by_parts and bool(text) and "  " not in text and text[0] != " " != text[-1] and "▁" not in text

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raws = [t.encode() for t in texts]
        whole = b" ".join(raws)
        starts, ends = wordhash.bounds(np.frombuffer(whole, np.uint8), _BLANK)
        ids, n = self._cache.encode(whole, starts, ends)
        begins = np.cumsum([0, *(len(r) + 1 for r in raws)])[:-1]
        return ids, np.bincount(np.searchsorted(begins, starts, side="right") - 1, n, len(texts)).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the number of ids of each."""
        simple = np.array([self._simple(t) for t in texts], bool)
        ids, n = self._words([t for t, ok in zip(texts, simple) if ok]) if simple.any() else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        if simple.all():
            return ids, n
        own = iter(np.split(ids, np.cumsum(n)[:-1]) if len(n) else [])
        parts = [next(own) if ok else np.array(self.processor.encode(t), np.int32) for t, ok in zip(texts, simple)]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Original byte span of every piece."""
        normal, align = self.normalise(text.encode())
        edges = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.width[ids], out=edges[1:])
        if edges[-1] != len(normal):  # unknown characters are as wide as their surface
            surfaces = [p.surface.encode() for p in self.processor.encode(text, out_type="immutable_proto").pieces]
            edges[1:] = np.cumsum([len(self.normalise(s)[0]) if i else len(s) for i, s in enumerate(surfaces)])
            edges = np.minimum(edges, len(normal))
        source = align[edges]
        return source[:-1], source[1:]


def encode(docs: DataFrame, model_path: str, with_decoded: bool = True) -> DataFrame:
    """(doc_id, ids, begins, ends, decoded): pieces of every whole text, their
    spans in its UTF-8 bytes, and the text that the ids decode to."""
    with open(model_path, "rb") as file:  # a small file beside the program, not data
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model.value)
        for batch in text_chunks(batches, limit=1 << 20):
            texts = batch.column("text").to_pylist()
            ids, lengths = codec.encode(texts)
            cuts = np.concatenate([[0], np.cumsum(lengths)])
            begins, ends, decoded = np.empty_like(ids), np.empty_like(ids), []
            for i, text in enumerate(texts):
                lo, hi = cuts[i], cuts[i + 1]
                begins[lo:hi], ends[lo:hi] = codec.spans(text, ids[lo:hi])
                decoded.append(codec.processor.decode(ids[lo:hi].tolist()) if with_decoded else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(ragged(x, lengths, pa.int32()) for x in (ids, begins, ends)),
                 pa.array(decoded, pa.string())], ["doc_id", "ids", "begins", "ends", "decoded"])

    return whole_text(docs).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, decoded) from (doc_id, ids)."""
    with open(model_path, "rb") as file:
        model = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model.value)
        for batch in batches:
            texts = [codec.processor.decode(x) if x else "" for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Digests of the ids, of their spans in the source (`begin:end`), and of the decoded text."""
    spans = F.transform(F.arrays_zip("begins", "ends"), lambda x: F.concat_ws(":", x["begins"], x["ends"]))
    return encoded.select(
        "doc_id",
        sha256(F.array_join(spans, ",")).alias("spans_sha256"),
        F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"),
    )
