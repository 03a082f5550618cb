"""Token ids as Parquet list columns.

Documents are dealt to ranges of their id, tokenised, and written in ascending
order. The file format is Parquet: ids are dictionary encoded (the dictionary
is bounded by the vocabulary), numbers that ascend are delta encoded, row
groups and pages have a given size, and page indexes let a reader fetch the
metadata, or the ids of a range of documents, alone.

Defined results: a null text counts as empty; every document ends with the end
id, so an empty one has exactly one id; a null doc_id comes first; rows with
the same doc_id are ordered by text; extra columns are left behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contagia.llm import wordhash
from contagia.llm.common import ragged, text_chunks, whole_text
from contagia.llm.wordcache import WordCache, flat

#: Text bytes per written file, before encoding.
FILE_BYTES = 64 << 20
_BLANK = wordhash.blank_table(b" \n")


def _borders() -> np.ndarray:
    """For two ASCII characters, whether the pre-tokenizer always cuts between them: letters, single digits and signs
    are tokens of their own, but for what follows an apostrophe."""
    kind = np.array([0 if c in b"' \n" or c > 127 else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)])
    a, b = kind[:, None], kind[None, :]
    return ((a > 0) & (b > 0) & ((a != b) | (a == 2))).ravel()


_BORDER = _borders()
LAYOUT = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "compression": "zstd",
}


class WordTokenizer:
    """The library's ids of whole texts, found part by part between ASCII spaces and signs.

    The normaliser turns white space into spaces and the pre-tokenizer drops
    them, and it cuts between letters, digits and signs, so a text is encoded
    as the concatenation of its parts.
    """

    _open: dict[str, WordTokenizer] = {}

    def __init__(self, definition: str) -> None:
        self._library = Tokenizer.from_str(definition)
        special = {t.content: i for i, t in self._library.get_added_tokens_decoder().items()}
        self._mark, self._mark_id = next(((s, i) for s, i in special.items()), (None, None))
        self._special = tuple(special)
        self._cache = WordCache(self._parts, 1_200_000)

    @classmethod
    def of(cls, definition: str) -> WordTokenizer:
        if definition not in cls._open:
            cls._open[definition] = cls(definition)
        return cls._open[definition]

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, parts: list[str], together: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Parts are encoded with a special token after each, and the ids cut at its id."""
        if self._mark is None or any(s in "".join(parts) for s in self._special):
            return flat(self._plain(parts))
        groups = [self._mark.join([*parts[i:i + together], ""]) for i in range(0, len(parts), together)]
        ids, _ = flat(self._plain(groups))
        marks = np.flatnonzero(ids == self._mark_id)
        if len(marks) != len(parts):
            raise ValueError("parts and ids do not match")
        return ids[ids != self._mark_id], np.diff(marks, prepend=-1) - 1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each.

        Only distinct parts that were not met before become objects."""
        raws = [t.encode() for t in texts]
        whole = b" ".join(raws)
        plain = b"<|" not in whole  # no special tokens, so the normaliser lowers all letters
        if plain:
            whole = whole.lower()
        raw = np.frombuffer(whole, np.uint8)
        starts, ends = wordhash.bounds(raw, _BLANK)
        if plain:
            cut = np.flatnonzero(_BORDER[raw[:-1].astype(np.uint16) << 8 | raw[1:]]) + 1
            starts, ends = np.sort(np.concatenate([starts, cut]), kind="stable"), np.sort(np.concatenate([ends, cut]), kind="stable")
        ids, n = self._cache.encode(whole, starts, ends)
        begins = np.cumsum([0, *(len(r) + 1 for r in raws)])[:-1]
        return ids, np.bincount(np.searchsorted(begins, starts, side="right") - 1, n, len(texts)).astype(np.int64)


def write(docs: DataFrame, definition_path: str, end_id: int, path: str, file_bytes: int = FILE_BYTES,
          layout: dict[str, str] | None = None) -> None:
    """Tokenise and write files of (doc_id, n_tokens, ids), ordered by id within and across files."""
    spark = docs.sparkSession
    with open(definition_path, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.of(definition.value)
        for batch in text_chunks(batches, limit=1 << 20):
            ids, lengths = tokenizer.encode(batch.column("text").to_pylist())
            ids = np.insert(ids, np.cumsum(lengths), end_id)
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("doc_id"), pa.array(lengths + 1, pa.int64()),
                 ragged(ids, lengths + 1, pa.int32())], ["part", "doc_id", "n_tokens", "ids"])

    text = whole_text(docs)
    total = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))
    ordered = (text.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
               .withColumn("part", F.spark_partition_id()))
    writer = ordered.mapInArrow(run, "part int, doc_id long, n_tokens long, ids array<int>").write
    for key, value in (layout or LAYOUT).items():
        writer = writer.option(key, value)
    writer.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files, in their order.

    Starts are the sums of all files before plus a running sum inside a file:
    the only window over everything has one row per file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values, cuts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(values, "<u4")).cast("B")
            sums = [zlib.crc32(raw[4 * lo:4 * hi]) for lo, hi in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("doc_id"), batch.column("row"), batch.column("n_tokens"),
                 pa.array(sums, pa.int64())], ["part", "doc_id", "row", "n_tokens", "ids_crc32"])

    files = spark.read.schema("part int, doc_id long, n_tokens long, ids array<int>").parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    rows = (files.select("part", "doc_id", F.col("_metadata.row_index").alias("row"), "n_tokens", "ids")
            .mapInArrow(run, "part int, doc_id long, row long, n_tokens long, ids_crc32 long"))
    inside = Window.partitionBy("part").orderBy("row")
    return (rows.withColumn("within", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
            .join(before, "part")
            .select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"))
