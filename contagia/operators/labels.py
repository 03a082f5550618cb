"""Label sets for training, testing and inference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contagia.params import RunParams


def _labelled(frame: DataFrame, value: int) -> DataFrame:
    return frame.select("pid", F.lit(value).cast("long").alias("covid"))


def training_labels(intervals: DataFrame, people: DataFrame, params: RunParams) -> DataFrame:
    """Cohort members infected up to the fixed ending are positive, `people` outside it negative."""
    positive = intervals.where(F.col("first_day") <= params.fixed_ending).select("pid").distinct()
    return _labelled(positive, 1).unionByName(_labelled(people.select("pid").distinct(), 0))


def positives_on_day(timeline: DataFrame, day: int) -> DataFrame:
    """People whose first infectious or recovered day is `day`."""
    first = F.least("first_infected", "first_recovered")  # least skips nulls
    return _labelled(timeline.where(first == day), 1)


def testing_labels(intervals: DataFrame, people: DataFrame, current: DataFrame) -> DataFrame:
    """New cases of the day against `people` who are still not infected."""
    new_cases = current.join(intervals.select("pid"), "pid", "left_anti")
    return _labelled(new_cases, 1).unionByName(inference_set(people, current))


def inference_set(people: DataFrame, current: DataFrame) -> DataFrame:
    """`people` outside the cohort who are no case of the day."""
    rest = people.select("pid").distinct().join(current.select("pid"), "pid", "left_anti")
    return _labelled(rest, 0)
