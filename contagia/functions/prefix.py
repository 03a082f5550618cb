"""Running sums over an order of any size.

Rows are dealt to ranges of the order, as many as their number asks for, and
summed up inside each range while it is sorted. Ranges are then offset by the
totals of those before them: one row per range and group is all that meets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from contagia.sources.workspace import Workspace

ROWS_PER_RANGE = 500_000
FEW_ROWS = 10_000  # not worth a range of their own


def number_of_ranges(rows: int, partitions: int, rows_per_range: int = ROWS_PER_RANGE) -> int:
    """Follows the rows; few rows are spread over the session's partitions at most."""
    return max(1, -(-rows // rows_per_range), min(partitions, -(-rows // FEW_ROWS)))


def running_sums(df: DataFrame, groups: Sequence[str], order: Sequence[Column], values: Sequence[str],
                 rows_per_range: int = ROWS_PER_RANGE, workspace: Workspace | None = None) -> DataFrame:
    """Add `running_<v>` (sum over the group up to and with the row) and `total_<v>` for each value column.

    The order has to tell the rows of a group apart. Null groups are a group; null values count as 0. The rows are
    written twice: once so that they are counted without being computed again, once with the sums inside ranges, so
    that totals and rows agree on the ranges whatever is computed anew."""
    spark = df.sparkSession
    workspace = (workspace or Workspace(spark, "running")).fresh("sums")
    rows = workspace.durable(df.withColumns({f"running_{v}": F.coalesce(F.col(v), F.lit(0)) for v in values}), "rows")
    n = number_of_ranges(rows.count(), int(spark.conf.get("spark.sql.shuffle.partitions")), rows_per_range)
    keyed = rows.withColumn("_group", F.xxhash64(*groups) if groups else F.lit(0).cast("long"))
    schema = StructType([*keyed.schema.fields, StructField("_range", IntegerType()), StructField("_segment", LongType())])
    sums = [f"running_{v}" for v in values]

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, last, carry = TaskContext.get().partitionId(), -1, None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("_group").to_numpy()
            new = np.append(last is None or group[0] != last, group[1:] != group[:-1])
            starts = np.flatnonzero(new)
            edges = [*([] if len(starts) and starts[0] == 0 else [0]), *starts.tolist(), len(group)]
            columns = {name: batch.column(name) for name in batch.schema.names}
            for name in sums:
                value = columns[name].to_numpy(zero_copy_only=False)
                out = np.cumsum(value) if len(edges) == 2 else np.concatenate([np.cumsum(value[a:b]) for a, b in zip(edges[:-1], edges[1:])])
                if not new[0]:
                    out[:edges[1]] += carry[name]
                carry[name] = out[-1]
                columns[name] = pa.array(out, batch.schema.field(name).type)
            segments = segment + np.cumsum(new)
            segment, last = int(segments[-1]), group[-1]
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(np.full(len(group), part, np.int32)), pa.array(segments)],
                                             [*columns, "_range", "_segment"])

    ordered = keyed.repartitionByRange(n, *groups, *order).sortWithinPartitions(*groups, *order)
    summed = workspace.durable(ordered.mapInArrow(accumulate, schema), "ranges")
    totals = summed.groupBy("_range", "_segment", *groups).agg(*(F.sum(F.coalesce(F.col(v), F.lit(0))).alias(f"_{v}") for v in values))
    before = Window.partitionBy(*groups).orderBy("_range", "_segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range", "_segment",
        *(F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values),
        *(F.sum(f"_{v}").over(Window.partitionBy(*groups)).alias(f"total_{v}") for v in values),
    )
    met = summed.join(offsets, ["_range", "_segment"]).withColumns({f"running_{v}": F.col(f"running_{v}") + F.col(f"_{v}") for v in values})
    return met.drop("_group", "_range", "_segment", *(f"_{v}" for v in values))
