"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SALT = "_spread"


def spread_join(fact: DataFrame, lookup: DataFrame, on: Sequence[str], spread_by: Sequence[str],
                how: str = "inner", spread: int = 2, shuffled: bool = False) -> DataFrame:
    """Join a large, possibly skewed `fact` with a `lookup` holding few rows per key.

    The rows of one key are spread over `spread` sub-keys by hashing
    `spread_by`, and the lookup rows are repeated that often. Because the
    lookup is shuffled on the sub-key and not reused from an aggregation below
    it, adaptive execution can also split what is still too large by bytes
    (its skew rule needs a plain shuffle on both sides). When the lookup turns
    out small at run time, adaptive execution broadcasts it instead.

    `shuffled` rules the broadcast out, for lookups with about a row per person:
    the planner takes rows out of an explode, or of well compressed files, for a
    tenth of their size, and what it has once planned as a broadcast it keeps.
    """
    # never null, and declared so: else the join filters this use of `fact` and its shuffle cannot serve another use
    salt = F.coalesce(F.pmod(F.xxhash64(*spread_by), F.lit(spread)).cast("int"), F.lit(0))
    salted = fact.withColumn(_SALT, salt)
    repeated = lookup.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    if shuffled:
        repeated = repeated.hint("merge")
    return salted.join(repeated, [*on, _SALT], how).drop(_SALT)


LEAST_PARTITIONS = 200


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Deal rows by `columns` over a given number of partitions, at least `LEAST_PARTITIONS`.

    For aggregations with nearly as many groups as rows, whose memory follows
    the rows of a task. Adaptive execution merges partitions by their
    compressed bytes up to a few per core, and rows of small numbers compress
    so well that a task then holds millions of groups; a given number is kept.
    """
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(session, LEAST_PARTITIONS), *columns)


def pinned(df: DataFrame, *columns: str) -> DataFrame:
    """Keep numeric `columns` alive in every use of `df`.

    When a frame is used twice with different columns, pruning turns it into
    two different plans and its shuffle runs twice. A condition that always
    holds, but that the optimizer cannot know to hold, makes both uses need
    the same columns, so the second one reuses the shuffle of the first.
    """
    smallest = F.lit(-(2**62))
    condition = F.lit(True)
    for column in columns:
        condition = condition & (F.coalesce(F.col(column), F.lit(0)) > smallest)
    return df.where(condition)
