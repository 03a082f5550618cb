"""Properties of the physical plans that decide how jobs scale."""

import contextlib
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from contagia.functions.joins import spread_join
from contagia.operators import exposure, flat
from contagia.params import RunParams
from contagia.sources import fixtures
from contagia.sources import tables as tables_io
from contagia.sources.workspace import Workspace
from rows import rows_of

SF = "/root/testdata/sf0.001"
P = RunParams(window=2, end_day=49, fixed_ending=49)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@contextlib.contextmanager
def _conf(spark, **values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", [
    "c2_contact_exposure_infected", "d2_place_exposure_infected", "d3_place_exposure_uninfected",
    "e2_household_exposure_uninfected", "g6_master_training", "h10_flat_frame_training",
    "b6_cohort_with_predicted", "g3_testing_labels", "i2_stratified_split",
])
def test_no_nested_loop_or_cross_join(spark, name):
    plan = _plan(entry.queries()[name](spark, SF))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_scans_read_only_needed_columns(spark):
    plan = _plan(exposure.place_links(fixtures.visits(spark, SF)))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan
    plan = _plan(flat.affected_cohort(fixtures.disease(spark, SF), P))
    assert "c_acctbal" in plan and "c_mktsegment" not in plan


def test_visits_are_aggregated_once_for_both_uses(spark):
    intervals = spark.createDataFrame([(1, 3, 9), (2, 4, 8)], "pid long, first_day long, last_day long")
    visits = fixtures.visits(spark, SF)
    terms = exposure.shared_terms(
        exposure.place_links(visits), intervals, exposure.infected_windows(intervals, 2), 2
    )
    terms.collect()
    plan = _plan(terms)
    final = plan[:plan.index("Initial Plan")]
    assert "ReusedExchange" in final or final.count("lineitem.parquet") == 1


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
    "spark.sql.shuffle.partitions": "16",
}


def _visits_with_hot_place(spark):
    """A third of 30000 visits at place 0."""
    return spark.range(0, 30000, 1, 8).select(
        F.col("id").alias("pid"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 2000).alias("lid"),
        F.lit(0).cast("long").alias("start_time"), F.lit(10).cast("long").alias("duration"),
    )


def test_hot_place_is_split(spark):
    visits = _visits_with_hot_place(spark)
    intervals = spark.range(0, 30000).where("id % 2 = 0").select(
        F.col("id").alias("pid"), (F.col("id") % 40).alias("first_day"),
        (F.col("id") % 40 + 6).alias("last_day"),
    )
    people = spark.range(0, 30000).where("id % 2 = 1").select(
        F.col("id").alias("pid"), F.lit(44).cast("long").alias("last_day")
    )
    links = exposure.place_links(visits)

    def terms():
        return exposure.fixed_terms(links, intervals, people, 2, 44)

    def all_terms():
        windows = exposure.infected_windows(intervals, 2).unionByName(exposure.fixed_windows(people))
        return exposure.shared_terms(links, intervals, windows, 2)

    for build in (terms, all_terms):
        plain = rows_of(exposure.place_exposure(build()))
        with _conf(spark, **SKEW):
            table = exposure.place_exposure(build())
            assert rows_of(table) == plain
            assert "skew=true" in _plan(table)


def test_hot_person_is_split(spark):
    """One person is an end of a third of all contacts."""
    network = spark.range(0, 30000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 3000).alias("pid1"),
        (F.col("id") + 100000).alias("pid2"), F.lit(0).alias("lid"),
    )
    intervals = spark.range(-1, 3000).select(
        F.col("id").alias("pid"), F.lit(3).cast("long").alias("first_day"),
        F.lit(9).cast("long").alias("last_day"),
    )
    plain = rows_of(exposure.contact_table(network, intervals))
    with _conf(spark, **SKEW):
        table = exposure.contact_table(network, intervals)
        assert rows_of(table) == plain
        assert "skew=true" in _plan(table)


def test_spread_join_is_split_and_equal(spark):
    fact = _visits_with_hot_place(spark).select("lid", "pid")
    totals = fact.groupBy("lid").agg(F.count(F.lit(1)).alias("n"))
    plain = rows_of(fact.join(totals, "lid", "left"))
    with _conf(spark, **SKEW):
        joined = spread_join(fact, totals, ["lid"], ["pid"], "left").select("lid", "pid", "n")
        assert rows_of(joined) == plain
        assert "skew=true" in _plan(joined)


def _lookup_tables(spark, path):
    """20000 people whose file is far smaller than their rows."""
    spark.range(20000).withColumnRenamed("id", "pid").coalesce(1).write.option("compression", "zstd").parquet(path)
    people = spark.read.schema("pid long").parquet(path)
    days = F.explode(F.array(F.struct(F.lit(3).cast("long").alias("first_day"), F.lit(9).cast("long").alias("last_day"))))
    return people.withColumn("i", days).select("pid", "i.*")


def test_cohort_is_not_broadcast_by_the_size_of_its_file(spark, tmp_path):
    intervals = _lookup_tables(spark, str(tmp_path / "people"))
    visits = spark.range(0, 40000, 1, 4).select(
        (F.col("id") % 20000).alias("pid"), (F.col("id") % 500).alias("lid"),
        F.lit(0).cast("long").alias("start_time"), F.lit(10).cast("long").alias("duration"))
    network = visits.select(F.col("pid").alias("pid1"), (F.col("pid") + 1).alias("pid2"), "lid")
    links, people = exposure.place_links(visits), intervals.select("pid", "last_day")
    windows = exposure.infected_windows(intervals, 2)
    with _conf(spark, **{"spark.sql.autoBroadcastJoinThreshold": "400000"}):
        for table in (exposure.contact_table(network, intervals), exposure.visits_with_interval(visits, intervals),
                      exposure.shared_terms(links, intervals, windows, 2), exposure.fixed_terms(links, intervals, people, 2, 10)):
            assert table.collect()
            assert "BroadcastHashJoin [pid" not in _plan(table)


def test_status_is_not_broadcast_by_the_size_of_its_file(spark):
    people = spark.range(20000).select(
        F.lit(1).cast("long").alias("client_id"), F.col("id").alias("pid"), (F.col("id") % 50).alias("hid"),
        F.lit(30).cast("long").alias("age"), F.lit(1).cast("long").alias("sex"))
    states = people.where("pid % 3 = 0").select("client_id", "pid", F.lit(20).cast("long").alias("day"), F.lit("I").alias("state"))
    network = people.select("client_id", F.col("pid").alias("pid1"), (F.col("pid") + 1).alias("pid2"), F.col("hid").alias("lid"))
    with _conf(spark, **{"spark.sql.autoBroadcastJoinThreshold": "500000"}):
        frame = flat.flat_frame(people, network, states, P, ("client_id",), Workspace(spark, "status"))
        assert frame.count() == 20000
        assert not re.search(r"BroadcastHashJoin \[[^\]]*pid", _plan(frame))


def _shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p.name for folder in folders for p in Path(folder.getPath()).rglob("shuffle_*.data")}


def test_stored_steps_leave_no_shuffle_files(spark, tmp_path):
    """A step that is written or collected has no more use for the shuffles that led to it."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    network = fixtures.network(spark, SF)
    contacts, before, asked = network.count(), _shuffle_files(spark), spark.conf.get(setting)
    stored = Workspace(spark, "step").durable(network, "network")
    tables_io.read_or_build(spark, str(tmp_path / "built"), network.schema, lambda: network)
    tables_io.write_predictions(network.select("pid1", F.lit(0.5).alias("score")).toDF("pid", "score"), str(tmp_path / "scores"))
    tables_io.fingerprint({"population_network": network}, ["population_network"])
    for _ in range(50):  # files are deleted in the background
        left = _shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(setting) == asked
    assert stored.count() == contacts and rows_of(stored) == rows_of(network)
