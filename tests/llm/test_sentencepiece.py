import struct

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from contagia.llm import sentencepiece_codec as codec

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
OWN = codec.Codec.of(open(PATH, "rb").read())
ODD = ["", " ", "  ", "a ", " a", "a  b", "x\ny z", "▁ ▁▁x", "日本 x😀", "<s> </s> <unk>", "é" * 400, "\x00\x01", "\u200bq", "tab\tq", "x" * 5000]


def check(texts):
    ids, sizes = OWN.encode(texts)
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    assert [p.tolist() for p in parts] == LIBRARY.encode(texts)
    for text, own in zip(texts, parts):
        raw = text.encode()
        begins, ends = OWN.spans(text, own)
        assert b"".join(raw[a:b] for a, b in zip(begins, ends)) == raw
        for i, a, b in zip(own.tolist(), begins, ends):
            if not LIBRARY.is_byte(i):
                piece = LIBRARY.id_to_piece(i)
                assert raw[a:b].decode().replace(" ", "▁") in (piece, piece[1:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \nab▁é😀"), st.characters(codec="utf-8")), max_size=30), min_size=1, max_size=6))
def test_any_text(texts):
    check(texts)


def test_odd_texts_and_sample(sample):
    check(ODD)
    check([t for _, t in sample])


def character_map(pairs):
    """A compiled map of single-step keys, built by hand: a double array and its texts."""
    texts, values = b"", {}
    for key, value in pairs.items():
        values[key] = len(texts)
        texts += value + b"\0"
    prefixes = sorted({k[:n] for k in pairs for n in range(len(k) + 1)}, key=len)
    base = {p: 256 * (i + 1) for i, p in enumerate(prefixes)}
    units = [0] * (256 * (len(prefixes) + 2))

    def unit(at, offset, label, leaf):
        units[at] = (at ^ offset) << 10 | label | leaf << 8

    unit(0, base[b""], 0, 0)
    for p in prefixes[1:]:
        unit(base[p[:-1]] ^ p[-1], base[p], p[-1], int(p in values))
        if p in values:
            units[base[p]] = values[p] | 1 << 31
    blob = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(blob)) + blob + texts


def test_longest_prefix_replacement_keeps_source_offsets():
    pairs = {b"A": b"a", b"AB": b"<ab>", "é".encode(): b"e", b"\t": b" ", b"x": b""}
    normal = codec.Normaliser(character_map(pairs), True, False, True)
    got, align = normal("AABéx\tz".encode())
    assert got.decode() == "▁a<ab>e▁z"
    assert align.tolist() == [0, 0, 0, 0, 1, 1, 1, 1, 3, 6, 6, 6, 7, 8]
    squeezed = codec.Normaliser(character_map(pairs), True, True, True)
    assert squeezed(b"  A \t b  ")[0].decode() == "▁a▁b"
    assert codec.Normaliser(b"", False, False, False)(b"a b")[0] == b"a b"


def test_table(docs):
    texts = [*ODD, None, *ODD]
    encoded = codec.encode(docs(texts, ids="'x'", decoded="0"), PATH)
    rows = encoded.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == LIBRARY.encode(texts[r.doc_id] or "") and r.decoded == LIBRARY.decode(r.ids)
    assert sorted(map(tuple, codec.decode(encoded, PATH).collect())) == sorted((r.doc_id, r.decoded) for r in rows)
    assert codec.encode(docs(texts).limit(0), PATH).count() == 0
