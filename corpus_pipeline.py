"""From raw documents to training tokens, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of `docs`; what it
decides takes effect. All but the last return the columns of the documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contagia.llm import decontaminate, line_dedup, sentencepiece_codec, simhash, toxicity
from contagia.llm.common import fresh_name, ship_package, table
from contagia.sources.workspace import Workspace

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go. The model learns from labels that are not held out."""
    ship_package(spark)
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later near-duplicate lines go; a document of which no word is left goes with them."""
    ship_package(spark)
    removed = fresh_name(docs, "removed")
    result = line_dedup.remove(docs, Workspace(spark, "pipeline-lines"), line_dedup.EVERY, removed_col=removed)
    emptied = F.col(removed).isNotNull() & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    size = F.when(F.col(removed).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return result.where(~emptied).withColumn("n_chars", size).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    ship_package(spark)
    return simhash.keep_one(docs, Workspace(spark, "pipeline-copies"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    ship_package(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), decontaminate.EVERY)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, begins, ends, decoded_sha256) of what is left."""
    ship_package(spark)
    pieces = sentencepiece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "begins", "ends",
                         F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again."""
    docs, workspace = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = workspace.durable(stage(spark, docs, sf_dir), name)
    return docs
