import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """docs([text, ...]) -> documents with ids 0, 1, ... ; or rows of (id, text)."""
    def build(texts, **extra):
        rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
        rows = [(*r, "en", f"s{i % 3}", len(r[1] or "")) if len(r) == 2 else (*r, len(r[1] or "")) for i, r in enumerate(rows)]
        return spark.createDataFrame(rows, DOCS).selectExpr("*", *(f"{v} AS {k}" for k, v in extra.items()))
    return build


@pytest.fixture
def workspace(spark):
    from contagia.sources.workspace import Workspace
    return Workspace(spark, "test")


@pytest.fixture(scope="session")
def sample(spark):
    """The texts of the smallest documents table."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
