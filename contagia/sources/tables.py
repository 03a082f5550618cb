"""Table sources and prediction sinks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contagia.functions.joins import dealt
from contagia.sources.schemas import OPTIONAL, TABLES
from contagia.sources.workspace import freed_shuffles


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header row; columns are taken by name order of the schema."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def _header_columns(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def read_table(spark: SparkSession, name: str, path: str, kind: str | None = None) -> DataFrame:
    """One input table from CSV or Parquet, projected to the columns in use.

    `kind` is "csv" or "parquet"; by default paths ending in .parquet are Parquet.
    A missing column raises, unless no result depends on it.

    A CSV may carry further columns in any order: its header line decides the
    read schema (only the header is looked at, no inference pass), columns
    without a known type stay strings and are pruned by the projection.
    """
    wanted = TABLES[name]
    if kind not in (None, "csv", "parquet"):
        raise ValueError(f"unknown format {kind!r}")
    if kind == "parquet" or kind is None and str(path).rstrip("/").endswith(".parquet"):
        frame = spark.read.parquet(str(path))
    else:
        known = {f.name: f for f in wanted.fields}
        header = _header_columns(spark, str(path))
        schema = StructType()
        for column in header:
            schema = schema.add(known[column]) if column in known else schema.add(column, "string")
        frame = read_csv(spark, str(path), schema)
    missing = [f.name for f in wanted.fields if f.name not in frame.columns]
    if set(missing) - OPTIONAL:
        raise ValueError(f"{name} at {path} has no column {', '.join(sorted(set(missing) - OPTIONAL))}")
    return frame.select(*[f.name for f in wanted.fields if f.name not in missing])


def load_tables(spark: SparkSession, locations: Mapping[str, str], kind: str | None = None) -> dict[str, DataFrame]:
    """All tables of a run, by name. Tables that no operator reads stay lazy and cost nothing."""
    return {name: read_table(spark, name, str(path), kind) for name, path in locations.items()}


def network_edges(network: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Contact edges reduced to who met whom where, without duplicates."""
    columns = [*keys, "pid1", "pid2", "lid"]
    return dealt(network.select(*columns), *columns).distinct()


def _is_complete(spark: SparkSession, path: str) -> bool:
    """True if a finished Spark write left its success marker at `path`."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(marker)


def _writer(frame: DataFrame, partition_by: str | None) -> DataFrameWriter:
    """An overwriting writer. Rows are first gathered by the partition column, or every
    task would write a file per folder; large folders are still split over tasks.
    """
    if partition_by is None:
        return frame.write.mode("overwrite")
    return frame.hint("rebalance", partition_by).write.mode("overwrite").partitionBy(partition_by)


def read_or_build(spark: SparkSession, path: str, schema: StructType,
                  build: Callable[[], DataFrame], partition_by: str | None = None) -> DataFrame:
    """Prepared-feature cache: read the finished dataset at `path`, or build and write it first."""
    if not _is_complete(spark, path):
        frame = build()
        with freed_shuffles(spark):
            _writer(frame, partition_by).parquet(path)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def fingerprint(tables: Mapping[str, DataFrame], names: Sequence[str]) -> str:
    """A digest of the rows of some tables, whatever their order and the order of their columns.

    Each table is summed up to three numbers in one aggregation, and those reach the driver."""
    def summary(name: str) -> DataFrame:
        columns = sorted(tables[name].columns)
        sums = (F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")).cast("string") for seed in (1, 2))
        return tables[name].agg(F.lit(",".join(columns)).alias("columns"), F.count(F.lit(1)).cast("string").alias("n"),
                                *(s.alias(f"s{i}") for i, s in enumerate(sums)))

    with freed_shuffles(tables[names[0]].sparkSession):
        rows = reduce(DataFrame.unionByName, (summary(name).withColumn("table", F.lit(name)) for name in names)).collect()  # a row per table
    return hashlib.md5(repr(sorted((r["table"], r["columns"], r["n"], r["s0"], r["s1"]) for r in rows)).encode()).hexdigest()


def align_to_format(fmt: DataFrame, scores: DataFrame, missing: float = 0.5) -> DataFrame:
    """One row per requested pid; people without a score get `missing`."""
    return (
        fmt.select("pid")
        .join(scores.select("pid", "score"), "pid", "left")
        .select("pid", F.coalesce("score", F.lit(missing)).alias("score"))
    )


def write_predictions(scores: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Predictions as CSV with a header; one folder per client where asked."""
    columns = ["pid", "score"] if partition_by is None else [partition_by, "pid", "score"]
    with freed_shuffles(scores.sparkSession):
        _writer(scores.select(*columns), partition_by).option("header", True).csv(path)
