"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contagia.sources.workspace import Workspace

#: Bytes of text that Python code inside a task works on at a time.
CHUNK_BYTES = 2 << 20
#: White space of the word definition: words are runs of anything else.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; every other column is left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def stash(df: DataFrame, workspace: Workspace, name: str) -> DataFrame:
    """Write `df` to the shared folder as compressed Parquet and return the written copy."""
    target = workspace.child(name)
    df.write.option("compression", "zstd").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have in any spelling."""
    taken, name = {c.lower() for c in df.columns}, f"_{base}"
    while name in taken:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps.

    Spark deletes them once the driver has collected the plans that made them, which may be long after they are of use.
    Results that were written do not need them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text",
                limit: int = CHUNK_BYTES, size: str | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most `limit` bytes of text (or one row), by the numbers in `size` if that is given."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(batch.column(size) if size else pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def ragged(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from the values of all rows and the number of values of each."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, wherever they run; once per application."""
    context = spark.sparkContext
    if _SHIPPED.get(context.applicationId):
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="contagia-")) / "contagia_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED[context.applicationId] = True


_SHIPPED: dict[str, bool] = {}
