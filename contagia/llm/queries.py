"""One registered query per training-data operator, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contagia.llm import (
    alignment,
    chat,
    decontaminate,
    line_dedup,
    phrases,
    quality,
    repeats,
    secrets,
    sentencepiece_codec,
    simhash,
    structure,
    token_files,
    toxicity,
)
from contagia.llm.common import sha256, ship_package, table
from contagia.sources.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codec.digests(sentencepiece_codec.encode(table(spark, sf_dir, "documents"), model))


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = Workspace(spark, "op7").child("tokens")
    token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, target)
    return token_files.read(spark, target)


@query
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"), F.col("source"), F.concat_ws("/", "source", "lang"), Workspace(spark, "op1"))


ORACLES["op1_secrets"] = secrets.SQL


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.report(table(spark, sf_dir, "documents"), trusted, Workspace(spark, "op10"))


@query
def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.remove_repeats(table(spark, sf_dir, "documents"), Workspace(spark, "op3")))


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark, "op4"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    tagger = toxicity.fit(documents, labels.where(~toxicity.held_out(F.col("doc_id"))))
    spans = F.array_join(F.transform(F.arrays_zip("starts", "ends"), lambda s: F.concat_ws(":", s["starts"], s["ends"])), ",")
    return toxicity.score(documents, tagger).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", spans.alias("spans"))


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), decontaminate.EVERY)


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"), Workspace(spark, "op2"), line_dedup.EVERY)


@query
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.format_chats(table(spark, sf_dir, "conversations"), Workspace(spark, "op8"))
    return turns.select("conv_id", "turn", "role", "action", "inserted", "cost", sha256(F.col("segment")).alias("segment_sha256"))


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.report(table(spark, sf_dir, "documents"), a, b, Workspace(spark, "op13"))


@query
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.report(table(spark, sf_dir, "documents"), Workspace(spark, "op12"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return structure.report(structure.damage(turns), turns, Workspace(spark, "op11"))
