"""The input tables of an outbreak study, derived from an order database.

Every table is a Spark job over the given Parquet files and grows with them.
A customer is a person, a part is a place, a line item is a visit of the buyer
to that place, and buyers of consecutive orders meet at the places of the
first order (they stand in line one after the other), so that the contact
list is linear in the number of line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HORIZON = 63  # days observed per person


# The columns in use; a given schema saves the footer read that inference would need.
COLUMNS = {
    "customer": "c_custkey long, c_nationkey int, c_acctbal double",
    "nation": "n_nationkey int, n_regionkey int",
    "orders": "o_orderkey long, o_custkey long",
    "lineitem": "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def person(spark: SparkSession, sf_dir: str, with_client: bool = False) -> DataFrame:
    """Households of four consecutive customers; the region is the federated client."""
    customer = _read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    columns = [
        key.alias("pid"),
        F.floor(key / 4).cast("long").alias("hid"),
        (key % 4 + 1).alias("person_number"),
        (F.floor(F.abs("c_acctbal")).cast("long") % 90).alias("age"),
        (F.col("c_nationkey") % 2 + 1).cast("long").alias("sex"),
    ]
    if with_client:
        nation = _read(spark, sf_dir, "nation")
        customer = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        columns.append(F.col("n_regionkey").cast("long").alias("client_id"))
    return customer.select(*columns)


def disease(spark: SparkSession, sf_dir: str, with_client: bool = False) -> DataFrame:
    """One state per person and day. Every fifth person recovers without symptoms."""
    people = person(spark, sf_dir, with_client)
    onset = (F.col("hid") * 37 + (F.col("pid") * 7) % 11) % 90
    length = 3 + F.col("age") % 7 + F.col("sex")
    timeline = people.withColumn("onset", onset).withColumn("length", length)
    days = F.sequence(F.lit(0).cast("long"), F.lit(HORIZON - 1).cast("long"))
    state = (
        F.when(F.col("day") >= F.col("onset") + F.col("length"), "R")
        .when((F.col("day") >= F.col("onset")) & (F.col("pid") % 5 != 0), "I")
        .otherwise("S")
    )
    keys = ["client_id"] if with_client else []
    return timeline.withColumn("day", F.explode(days)).select(*keys, "day", "pid", state.alias("state"))


def _purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_partkey").alias("lid"),
        (F.col("l_linenumber").cast("long") * 3600).alias("start_time"),
        (F.col("l_quantity") * 60).cast("long").alias("duration"),
        F.col("l_linenumber").cast("long").alias("activity"),
    )
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("pid"))
    return lineitem.join(orders, "o_orderkey")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is a visit of the buyer to a place."""
    return _purchases(spark, sf_dir).select("pid", "lid", "start_time", "duration")


def network(spark: SparkSession, sf_dir: str, with_client: bool = False) -> DataFrame:
    """Buyers of consecutive orders meet; each edge is stored once with pid1 < pid2."""
    here = _purchases(spark, sf_dir)
    following = _read(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") - 1).alias("o_orderkey"),
        F.col("o_custkey").alias("other"),
    )
    edges = (
        here.join(following, "o_orderkey")
        .where(F.col("pid") != F.col("other"))
        .select(
            F.least("pid", "other").alias("pid1"),
            F.greatest("pid", "other").alias("pid2"),
            "lid",
            "start_time",
            "duration",
            F.col("activity").alias("activity1"),
            (F.col("activity") % 3).alias("activity2"),
        )
    )
    if with_client:
        home = person(spark, sf_dir, True).select(F.col("pid").alias("pid1"), "client_id")
        edges = edges.join(home.hint("shuffle_hash"), "pid1").select(  # one row per person, so the contacts need no sort
            "client_id", "pid1", "pid2", "lid", "start_time", "duration", "activity1", "activity2"
        )
    return edges


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All seven input tables under the names callers use."""
    people = person(spark, sf_dir)
    stays = visits(spark, sf_dir)
    return {
        "person": people,
        "household": people.select("hid").distinct(),
        "residence_location": people.select("hid", F.col("hid").alias("rlid")).distinct(),
        "activity_location": stays.select("lid").distinct(),
        "activity_location_assignment": stays,
        "population_network": network(spark, sf_dir),
        "disease_outcome_training": disease(spark, sf_dir),
    }


def client_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of the flat feature set, each row tagged with its client."""
    return {
        "person": person(spark, sf_dir, True),
        "population_network": network(spark, sf_dir, True),
        "disease_outcome_training": disease(spark, sf_dir, True),
    }


def prediction_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everyone is asked for, with a dummy score."""
    return person(spark, sf_dir).select("pid", F.lit(0.5).alias("score"))


def extra_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients predicted for day 49: people of 60 and over."""
    return (
        person(spark, sf_dir)
        .where(F.col("age") >= 60)
        .select("pid", F.lit(49).cast("long").alias("first_day"))
    )


def with_rare_recovery(people: DataFrame, timeline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables with one more person (the negative of the largest id), ill for 40 days like nobody else."""
    one = people.agg((-F.max("pid")).alias("pid"))
    known = F.lit(0).cast("long"), F.lit(39).cast("long"), F.lit(40).cast("long"), F.lit(40).cast("long")
    member = one.select("pid", F.col("pid").alias("hid"), *(F.lit(v).cast("long").alias(c) for c, v in
                        (("person_number", 1), ("age", 30), ("sex", 1))))
    names = ("first_infected", "last_infected", "first_recovered", "recovered_after")
    illness = one.select("pid", *(v.alias(c) for c, v in zip(names, known)))
    return people.unionByName(member), timeline.unionByName(illness)
