"""Positions, splits and parts in a fixed pseudo-random order, without a global sort.

The order is by a hash of the person id, then by the id itself. The hash has a
fixed range of about a million values: rows are numbered inside their value, and
values are offset by the number of rows of the values before them, bucket by
bucket. No task ever sees a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Multiplier and prime of the ordering hash, and the bucket width.
HASH_FACTOR = 2654435761
HASH_PRIME = 1000003
BUCKET_WIDTH = 1000


def order_hash(pid: str = "pid") -> Column:
    """(pid * factor) mod prime, reduced first so that large ids cannot overflow."""
    return (F.pmod(F.col(pid), F.lit(HASH_PRIME)) * F.lit(HASH_FACTOR)) % F.lit(HASH_PRIME)


def with_position(df: DataFrame, groups: Sequence[str] = (), pid: str = "pid") -> DataFrame:
    """Add `_position` (from 1, in hash order within the group) and `_group_size`.

    Rows are numbered inside their hash value, so a group falls into as many
    pieces as it has hash values, up to a million. Hash values are offset in
    two steps, inside a bucket of values and by buckets, and no task sees more
    than about a thousand rows for that.
    """
    groups = list(groups)
    hashed = df.withColumn("_hash", order_hash(pid))
    bucket = F.floor(F.col("_hash") / BUCKET_WIDTH).cast("int").alias("_bucket")
    sizes = hashed.groupBy(*groups, "_hash").agg(F.count(F.lit(1)).alias("_n")).select("*", bucket)
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sizes.groupBy(*groups, "_bucket").agg(F.sum("_n").alias("_m")).select(
        *groups,
        "_bucket",
        F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_below"),
        F.sum("_m").over(Window.partitionBy(*groups)).alias("_group_size"),
    )
    within = Window.partitionBy(*groups, "_bucket").orderBy("_hash").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_inside", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(buckets, [*groups, "_bucket"]).select(
        *groups, "_hash", (F.col("_below") + F.col("_inside")).alias("_offset"), "_group_size"
    )
    inside = Window.partitionBy(*groups, "_hash").orderBy(pid)
    return (
        hashed.join(offsets, [*groups, "_hash"])
        .withColumn("_position", F.col("_offset") + F.row_number().over(inside))
        .drop("_hash", "_offset")
    )


def stratified_split(df: DataFrame, label: str, groups: Sequence[str] = (),
                     test_share: float = 0.1, pid: str = "pid") -> DataFrame:
    """Add `is_test`: the first ceil(share * n) rows of each label (and group) in hash order."""
    ranked = with_position(df, [*groups, label], pid)
    test = F.col("_position") <= F.ceil(F.lit(test_share) * F.col("_group_size"))
    return ranked.withColumn("is_test", F.when(test, 1).otherwise(0).cast("long")).drop(
        "_position", "_group_size"
    )


def equal_parts(df: DataFrame, parts: int, groups: Sequence[str] = (), pid: str = "pid") -> DataFrame:
    """Add `part` (from 1): `parts` nearly equal parts in hash order, larger ones first."""
    ranked = with_position(df, groups, pid)
    size = F.col("_group_size")
    small = F.floor(size / parts)
    larger = size % parts
    index = F.col("_position") - 1
    edge = larger * (small + 1)
    # greatest() only guards the branch that is not taken against division by zero
    part = F.when(index < edge, F.floor(index / (small + 1))).otherwise(
        larger + F.floor((index - edge) / F.greatest(small, F.lit(1)))
    )
    return ranked.withColumn("part", (part + 1).cast("long")).drop("_position", "_group_size")
