"""Exposure per day of the look-back window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTACT = "infected_interactions"
PLACE = "infected_interactions_loc"
HOUSEHOLD = "family_infected"


def lag_columns(name: str, window: int) -> list[str]:
    return [f"{name}_lag_day_{d}" for d in range(window)]


def lag_pivot(exposure: DataFrame, measure: str, name: str, window: int) -> DataFrame:
    """Sum of `measure` over the rows that cover day window_end - d, for all d at once.

    Takes exposure rows or the terms they are summed from; both add up alike.
    """
    value = F.col(measure)
    day = [F.col("window_end") - d for d in range(window)]
    sums = [
        F.sum(F.when(day[d].between(F.col("max_end"), F.col("min_end")), value).otherwise(0)).alias(column)
        for d, column in enumerate(lag_columns(name, window))
    ]
    return exposure.groupBy("pid").agg(*sums)
