import hashlib
import re

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from contagia.llm import decontaminate, toxicity
from contagia.llm.common import table
from contagia.sources.workspace import Workspace

from test_line_dedup import brute as brute_lines
from test_simhash import brute_components, brute_fingerprint

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage."""
    docs, workspace, out = table(spark, SMALL, "documents"), Workspace(spark, "stages"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = workspace.durable(stage(spark, docs, SMALL), name)
        out[name] = docs, after
        docs = after
    return out


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_columns(stages, spark):
    columns = table(spark, SMALL, "documents").columns
    assert all(after.columns == columns for name, (_, after) in stages.items() if name != "sentencepiece")


def test_toxicity(stages, spark):
    before, after = stages["toxicity"]
    labels = table(spark, SMALL, "labels").where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    tagger = toxicity.fit(before, labels)
    want = {i: t for i, t in texts(before).items() if tagger.tag([t])[0][0] < 0.5}
    assert texts(after) == want and 0.8 * before.count() < len(want)


def test_lines(stages):
    before, after = stages["line_dedup"]
    rows, want = sorted(texts(before).items()), {}
    for (i, t), gone in zip(rows, brute_lines(rows, 1)):
        kept = "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone)
        if not gone or re.search("[^\x20\x09-\x0D]", kept):
            want[i] = kept
    assert texts(after) == want and len(want) < len(rows)
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_copies(stages):
    before, after = stages["simhash"]
    own = texts(before)
    ids = sorted(own)
    component = brute_components(ids, [brute_fingerprint(own[i]) for i in ids])
    assert texts(after) == {i: own[i] for i in set(component.values())}


def test_leaks(stages, spark):
    before, after = stages["decontaminate"]
    items = [decontaminate.normalise(r.text) for r in table(spark, SMALL, "benchmark").collect()]
    own, left = texts(before), texts(after)
    leaked = {i for i, t in own.items() if any(x in decontaminate.normalise(t) for x in items)}
    assert leaked and not leaked & left.keys() and left.items() <= own.items()
    assert len(own) - len(left) <= 2 * len(leaked) + 2


def test_tokens(stages):
    before, after = stages["sentencepiece"]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = texts(before)
    rows = after.collect()
    assert {r.doc_id for r in rows} == own.keys()
    for r in rows:
        raw = own[r.doc_id].encode()
        assert r.ids == library.encode(own[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(library.decode(r.ids).encode()).hexdigest()
        assert b"".join(raw[a:b] for a, b in zip(r.begins, r.ends)) == raw


def test_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 5000, "en", "s", 25000), (2, "word " * 5000, "en", "s", 25000),
            (None, "a b c d e f", None, "s", 11), (3, "A b c d e f", None, "s", 11)]
    docs = spark.createDataFrame(rows, schema)
    for frame in (docs, docs.limit(0)):
        left, workspace = frame, Workspace(spark, "odd")
        for name, stage in corpus_pipeline.STAGES:
            left = workspace.durable(stage(spark, left, SMALL), name)
        assert left.count() <= frame.count()


def test_run_gives_the_rows_of_the_stages(stages, spark):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).select("doc_id", "n_tokens", "decoded_sha256").collect())) == \
        sorted(map(tuple, stages["sentencepiece"][1].select("doc_id", "n_tokens", "decoded_sha256").collect()))
