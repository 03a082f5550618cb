"""Secret scan with corpus-wide ownership of every candidate.

Spans of the base patterns are found in every whole text. The values found are
hashed, and each hash is counted by distinct repositories and owners: a value
that many owners hold is a copied example, one that a single owner holds looks
live. Long mixed-character strings without a key word around them count as
candidates too, and become spans only where they are owner-specific.

Built-in functions only. Spark has no function for match positions, so the text
is split at the matches and positions are running sums over pieces and matches.

Defined results: a null text counts as empty; positions are code points, ends
exclusive; rows that repeat an id and a text all get the same result; a null
owner or repository counts as one owner or repository of its own; columns other
than the id, text, owner and repository are left behind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contagia.functions.joins import spread_join
from contagia.llm.common import sha256, stash
from contagia.sources.workspace import Workspace

#: The base patterns, in the order of their names in a tie.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
    "mixed": r"[A-Za-z0-9+/_-]{32,}",
}
KINDS = list(PATTERNS)


@dataclass(frozen=True)
class SecretRules:
    min_assigned: int = 8
    min_access: int = 16
    #: A value held by this many owners or more is a copied example.
    shared_owners: int = 3


def _found(kind: str) -> Column:
    """Matches of one kind with the length of the text before each."""
    pattern = F.lit(PATTERNS[kind])
    matches = F.regexp_extract_all("text", pattern, F.lit(0))
    gaps = F.transform(F.split("text", pattern, -1), F.length)
    pairs = F.arrays_zip(matches.alias("value"), gaps.alias("gap"))
    rows = F.transform(F.slice(pairs, F.lit(1), F.size(matches)),
                       lambda p: F.struct(F.lit(KINDS.index(kind)).alias("kind"), p["gap"].alias("gap"), p["value"].alias("value")))
    return F.when(F.col("text").rlike(PATTERNS[kind]), rows)


def scan(docs: DataFrame, owner: Column, repository: Column, workspace: Workspace, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per document with all matches, stored; the texts are read once."""
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), owner.cast("string").alias("owner"),
                       repository.cast("string").alias("repository"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    empty = F.array().cast("array<struct<kind:int,gap:int,value:string>>")
    found = F.concat(*(F.coalesce(_found(k), empty) for k in KINDS))
    return stash(text.select("doc_id", "owner", "repository", F.xxhash64("text").alias("text_key"),
                             found.alias("found")), workspace, "matches")


def candidates(scanned: DataFrame, rules: SecretRules = SecretRules()) -> DataFrame:
    """Every match that holds, with its position and the hash of its value."""
    rows = (scanned.where(F.size("found") > 0)
            .select("doc_id", "text_key", "owner", "repository", F.posexplode("found").alias("at", "m"))
            .select("doc_id", "text_key", "owner", "repository", "at", "m.*").distinct())
    order = Window.partitionBy("doc_id", "text_key", "owner", "repository", "kind").orderBy("at")
    end = F.sum(F.col("gap") + F.length("value")).over(order)
    value = F.col("value")
    mixed = value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9].*[0-9]")
    secret = F.when(F.col("kind") == 0, F.regexp_extract("value", ASSIGN, 2)).otherwise(value)
    holds = (F.when(F.col("kind") == 0, F.length(F.regexp_extract("value", ASSIGN, 2)) >= rules.min_assigned)
             .when(F.col("kind") == 1, F.length("value") >= rules.min_access)
             .when(F.col("kind") == 2, F.lit(True)).otherwise(mixed))
    return (rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
            .where(holds).withColumn("hash", F.sha2(secret.cast("binary"), 256))
            .drop("at", "gap", "value"))


def ownership(found: DataFrame) -> DataFrame:
    """Distinct owners and repositories of every hash. Both counts come from
    plain sums over distinct pairs, so a hash in a third of the documents is
    reduced before each shuffle."""
    tagged = found.select("hash", F.explode(F.array(
        F.struct(F.lit("owners").alias("of"), F.col("owner").alias("name")),
        F.struct(F.lit("repositories").alias("of"), F.col("repository").alias("name")))).alias("p")).select("hash", "p.*").distinct()
    return tagged.groupBy("hash").agg(F.count(F.when(F.col("of") == "owners", 1)).alias("owners"),
                                      F.count(F.when(F.col("of") == "repositories", 1)).alias("repositories"))


def spans(found: DataFrame, rules: SecretRules = SecretRules()) -> DataFrame:
    """(doc_id, text_key, kind, start, end, owners, repositories, live): base spans, and
    owner-specific candidates without a key word that overlap none of them."""
    counted = spread_join(found, ownership(found), ["hash"], ["doc_id", "start"], spread=8)
    spot = counted.groupBy("doc_id", "text_key", "kind", "start", "end").agg(
        F.max("owners").alias("owners"), F.max("repositories").alias("repositories"))
    order = Window.partitionBy("doc_id", "text_key").orderBy("start", "kind")
    base = F.col("kind") < 3
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return (spot.withColumn("free", free).withColumn("live", F.col("owners") < rules.shared_owners)
            .where(base | (F.col("free") & F.col("live"))).drop("free"))


def report(docs: DataFrame, owner: Column, repository: Column, workspace: Workspace,
           rules: SecretRules = SecretRules()) -> DataFrame:
    """One row per document: counts, digests, all spans, and how many look live or copied."""
    scanned = scan(docs, owner, repository, workspace)
    held = spans(candidates(scanned, rules), rules)
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    spot = F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("span"))
    base = F.col("kind") < 3

    def joined(rows: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(rows), lambda r: r["span"]), ",")

    per_doc = held.groupBy("doc_id", "text_key").agg(
        *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{KINDS[k]}") for k in range(3)),
        joined(F.collect_list(F.when(base, spot))).alias("base"), joined(F.collect_list(spot)).alias("spans"),
        F.count(F.when(F.col("live"), 1)).alias("n_live"), F.count(F.when(~F.col("live"), 1)).alias("n_copied"))
    empty, zero = F.lit(""), F.lit(0)
    per_doc = per_doc.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    return scanned.select("doc_id", "text_key").join(per_doc, same, "left").select(
        "doc_id", *(F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in KINDS[:3]),
        sha256(F.coalesce("base", empty)).alias("base_sha256"), F.coalesce("spans", empty).alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"))


#: The same rows in plain SQL; owner is the source, repository the source and language.
SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, source AS owner, concat_ws('/', source, lang) AS repository FROM documents),
matched AS (
    SELECT doc_id, text, owner, repository, 0 AS kind, 'assign' AS name, regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS ms,
        regexp_split_to_array(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps FROM docs
    UNION ALL SELECT doc_id, text, owner, repository, 1, 'access', regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_split_to_array(text, 'AKIA[A-Z0-9]+') FROM docs
    UNION ALL SELECT doc_id, text, owner, repository, 2, 'hex', regexp_extract_all(text, '[0-9a-f]{32,}'), regexp_split_to_array(text, '[0-9a-f]{32,}') FROM docs
    UNION ALL SELECT doc_id, text, owner, repository, 3, 'mixed', regexp_extract_all(text, '[A-Za-z0-9+/_-]{32,}'), regexp_split_to_array(text, '[A-Za-z0-9+/_-]{32,}') FROM docs),
rows AS (SELECT doc_id, owner, repository, kind, name, unnest(range(1, len(ms) + 1)) AS i, ms, gaps FROM matched WHERE len(ms) > 0),
placed AS (SELECT doc_id, owner, repository, kind, name, ms[i] AS value,
        sum(length(gaps[i]) + length(ms[i])) OVER (PARTITION BY doc_id, kind ORDER BY i) AS "end" FROM rows),
held AS (SELECT *, "end" - length(value) AS start,
        CASE WHEN kind = 0 THEN regexp_extract(value, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) ELSE value END AS secret FROM placed),
good AS (SELECT * FROM held WHERE CASE kind WHEN 0 THEN length(secret) >= 8 WHEN 1 THEN length(value) >= 16 WHEN 2 THEN TRUE
        ELSE regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9].*[0-9]') END),
owned AS (SELECT secret, count(DISTINCT owner) AS owners FROM good GROUP BY secret),
counted AS (SELECT g.*, o.owners < 3 AS live FROM good g JOIN owned o USING (secret)),
kept AS (SELECT * FROM counted c WHERE kind < 3 OR (live AND NOT EXISTS (
        SELECT 1 FROM counted b WHERE b.doc_id = c.doc_id AND b.kind < 3 AND b.start < c."end" AND c.start < b."end"))),
per_doc AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        string_agg(concat_ws(':', name, CAST(start AS BIGINT), CAST("end" AS BIGINT)), ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
        string_agg(concat_ws(':', name, CAST(start AS BIGINT), CAST("end" AS BIGINT)), ',' ORDER BY start, kind) AS spans,
        count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM docs d LEFT JOIN per_doc USING (doc_id)
"""
