import glob
import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from contagia.llm import token_files
from contagia.llm.token_files import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "\n\n", "it's  I'LL\tdon't", "a\u0301 \u0301b Ⅷ", "<|endoftext|> x<|startoftext|>y <|endof text|>", "日本語 テスト", "ΑΣ ΟΔΟΣ", "\x1cq\x85r\u2028s",
       "é" * 500, "😀😀 😀", "12345 6.7", "x" * 3000, "a\x00b"]


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def check(texts):
    own = WordTokenizer.of(open(PATH, encoding="utf-8").read())
    ids, sizes = own.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [ids_of(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40), min_size=1, max_size=6))
def test_any_text_is_encoded_as_the_library_does(texts):
    check(texts)


def test_odd_texts():
    check(ODD)
    check([" ".join(ODD), "\n".join(ODD)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("aZsStTlLmMdD'.,!?-_<|>()09 \n\té\u0301\x00\x1c\u00a0", max_size=60), min_size=1, max_size=6))
def test_letters_digits_and_signs(texts):
    check(texts)
    check([x for x in ODD if "<|" not in x] + [t.replace("<", "") for t in texts])


def brute(rows):
    out, start = [], 0
    for i, text in rows:
        ids = ids_of(text or "") + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_and_reading_back(docs, workspace, spark, sample):
    rows = sorted([*sample, (5000, None), *((5001 + i, t) for i, t in enumerate(ODD)), (-7, "first of all")])
    target = workspace.child("tokens")
    token_files.write(docs(rows, ids="1", part="2"), PATH, 2, target, file_bytes=100_000)
    got = sorted(map(tuple, token_files.read(spark, target).collect()))
    assert got == sorted(brute(rows))
    files = sorted(f for f in glob.glob(f"{target.removeprefix('file://')}/*.parquet") if pq.read_metadata(f).num_rows)
    assert len(files) > 1
    ids = [i for f in files for i in pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()]
    assert ids == sorted(i for i, _ in rows)
    for f in files:
        group = pq.read_metadata(f).row_group(0)
        columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
        assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index


def test_ties_nulls_and_no_rows(docs, workspace, spark):
    target = workspace.child("ties")
    token_files.write(docs([(3, "b"), (None, "a a"), (3, "b"), (3, "c c c")]), PATH, 2, target)
    rows = token_files.read(spark, target).collect()
    assert len(rows) == 4 and sorted(r.start for r in rows)[0] == 0
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [None, 3, 3, 3]
    ordered = sorted(rows, key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:]))
    token_files.write(docs(["x"]).limit(0), PATH, 2, workspace.child("none"))
    assert token_files.read(spark, workspace.child("none")).count() == 0


def test_layout_is_a_parameter(docs, workspace, spark):
    target = workspace.child("groups")
    layout = token_files.LAYOUT | {"parquet.block.size": "65536", "parquet.page.size": "4096"}
    token_files.write(docs(["one two three " * 800] * 60), PATH, 2, target, layout=layout)
    groups = [pq.read_metadata(f).num_row_groups for f in glob.glob(f"{target.removeprefix('file://')}/*.parquet")]
    assert max(groups) >= 1 and json.dumps(groups)
