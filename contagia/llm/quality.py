"""Quality rules and a hashed n-gram likelihood ratio.

Rules look at one document: its words, symbols, repeated lines and repeated
word windows. The ratio compares two multinomials over hashed word unigrams and
bigrams, one of trusted documents and one of the whole raw corpus; a document
scores the mean of log(p_trusted / p_raw) over its n-grams, and is kept if it
reaches a fixed threshold. Built-in functions only.

Both models are counts over all their documents. The trusted ids are stored and
counted first: up to `broadcast_ids` are broadcast, more meet the texts by a
shuffle.

Defined results: a null text has no words and fails the rules; ties and
repeated rows are judged each on their own; an empty table gives an empty
table; a document without n-grams scores 0; without any trusted document all
ratios are 0. Extra columns are left behind.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contagia.llm.common import whole_text
from contagia.sources.workspace import Workspace

SYMBOLS = "#*$%&|<>"
_SPLIT = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"
WINDOW = 3
_LOW = (1 << 24) - 1


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    buckets: int = 1 << 14
    #: Trusted ids that may be broadcast: 8 MB of numbers.
    broadcast_ids: int = 1_000_000
    #: Added to every bucket of both models.
    smoothing: float = 1.0
    #: Mean log ratio that a document must reach.
    threshold: float = -0.07


def _repeated_words(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words: positions covered by word windows that occur twice or more.

    Windows are sorted as numbers, the upper bits of their hash before their
    position, so equal ones are neighbours, and neighbours of one hash are
    compared word by word. Only where different windows share these bits, or
    where positions have more than 24 bits, the windows themselves are sorted.
    """
    n, words = F.col("n_words").cast("int"), F.col("words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    low = F.lit(_LOW).cast("long")
    number = lambda i: F.xxhash64(*(words[i + k] for k in range(WINDOW))).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))
    docs = docs.withColumn("_sorted", F.sort_array(F.when(n <= _LOW, F.transform(starts, number))))
    place = lambda x: x.bitwiseAND(low).cast("int")
    at = lambda k: F.get(F.col("_sorted"), k)
    near = lambda x, y: F.shiftright(x, 24) == F.shiftright(y, 24)
    same = lambda x, y: reduce(Column.__and__, (words[place(x) + k] == words[place(y) + k] for k in range(WINDOW)))
    # 1: as the one before; 2: another window of the same bits
    docs = docs.withColumn("_before", F.transform("_sorted", lambda x, k: F.when((k > 0) & near(x, at(k - 1)), F.when(same(x, at(k - 1)), 1).otherwise(2)).otherwise(0)))
    own, following = lambda k: F.get(F.col("_before"), k) == 1, lambda k: F.coalesce(F.get(F.col("_before"), k + 1) == 1, F.lit(False))
    by_hash = F.filter(F.transform("_sorted", lambda x, k: F.when(own(k) | following(k), place(x))), lambda i: i.isNotNull())
    window = lambda i: F.concat_ws(" ", *(words[i + k] for k in range(WINDOW)))
    strings = F.sort_array(F.transform(starts, lambda i: F.struct(window(i).alias("w"), i.alias("i"))))
    docs = docs.withColumn("_strings", F.when(F.col("_sorted").isNull() | F.array_contains("_before", 2), strings))
    text = lambda k: F.get(F.col("_strings"), k)["w"]
    by_string = F.filter(F.transform("_strings", lambda x, k: F.when((x["w"] == text(k - 1)) | (x["w"] == text(k + 1)), x["i"])), lambda i: i.isNotNull())
    again = F.when(F.col("_strings").isNotNull(), by_string).when(F.array_contains("_before", 1), by_hash)
    docs = docs.withColumn("_again", F.sort_array(again)).drop("_sorted", "_before", "_strings")
    covered = F.aggregate(
        "_again", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n"), (i + WINDOW).alias("end")),
        lambda acc: acc["n"])
    return docs.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_again")


def _split(texts: DataFrame) -> DataFrame:
    return texts.withColumn("words", F.array_remove(F.split("text", _SPLIT, -1), ""))


def with_words(docs: DataFrame) -> DataFrame:
    return _split(whole_text(docs))


def rules(docs: DataFrame, rule: QualityRules = QualityRules()) -> DataFrame:
    """Adds the measures and base_failed to a frame with words."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(_WORD))
    docs = (docs.withColumn("n_words", F.size("words").cast("long"))
            .withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
            .withColumn("n_symbols", F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"))
            .withColumn("_lines", lines)
            .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines"))
    docs = _repeated_words(docs)
    failed = (F.col("n_words") < rule.min_words) | (100 * F.col("n_repeat_words") > rule.max_repeat_percent * F.col("n_words"))
    return docs.withColumn("base_failed", failed)


def _grams(buckets: int) -> Column:
    """Buckets of all unigrams and bigrams."""
    bucket = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")
    words = F.col("words")
    pairs = F.when(F.size(words) >= 2, F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: bucket(words[i], words[i + 1])))
    return F.concat(F.transform(words, lambda w: bucket(w)), F.coalesce(pairs, F.array().cast("array<int>")))


def log_ratios(docs: DataFrame, trusted: DataFrame, workspace: Workspace, rule: QualityRules = QualityRules()) -> DataFrame:
    """(bucket, ratio) for every bucket, from whole texts and `trusted` (doc_id)."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    ids = workspace.durable(ids, "trusted").withColumn("_trusted", F.lit(1))
    few = ids.count() <= rule.broadcast_ids
    grams = (_split(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left"))
             .select(F.explode(_grams(rule.buckets)).alias("bucket"), F.coalesce("_trusted", F.lit(0)).alias("t")))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("good"))
    every = docs.sparkSession.range(rule.buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    every = every.select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("raw", "good")))
    whole = Window.partitionBy()  # over one row per bucket
    share = lambda c: (F.col(c) + rule.smoothing) / (F.sum(c).over(whole) + F.lit(rule.smoothing * rule.buckets))
    ratio = F.when(F.sum("good").over(whole) > 0, F.log(share("good") / share("raw"))).otherwise(F.lit(0.0))
    return every.select("bucket", ratio.alias("ratio"))


def score(docs: DataFrame, ratios: DataFrame, rule: QualityRules = QualityRules()) -> DataFrame:
    """Adds score and kept. The ratios are one array of fixed length, held as a scalar."""
    vector = ratios.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "ratio"))), lambda x: x["ratio"]).alias("v")).scalar()
    docs = docs.withColumn("_grams", _grams(rule.buckets)).withColumn("_ratios", vector)
    mean = F.aggregate("_grams", F.lit(0.0), lambda acc, b: acc + F.get(F.col("_ratios"), b)) / F.greatest(F.size("_grams"), F.lit(1))
    return docs.withColumn("score", mean).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= rule.threshold)).drop("_grams", "_ratios")


def report(docs: DataFrame, trusted: DataFrame, workspace: Workspace, rule: QualityRules = QualityRules()) -> DataFrame:
    ratios = log_ratios(whole_text(docs), trusted, workspace, rule)
    return score(rules(with_words(docs), rule), ratios, rule).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
