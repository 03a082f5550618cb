"""Explicit table schemas, so that no read needs an inference pass."""

from pyspark.sql.types import (
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _longs(*names: str) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


PERSON = _longs("pid", "hid", "person_number", "age", "sex")
DISEASE = StructType(
    [
        StructField("day", LongType()),
        StructField("pid", LongType()),
        StructField("state", StringType()),
    ]
)
NETWORK = _longs("pid1", "pid2", "lid", "start_time", "duration", "activity1", "activity2")
VISITS = _longs("pid", "lid", "start_time", "duration")
HOUSEHOLD = _longs("hid")
RESIDENCE = _longs("hid", "rlid")
PLACE = _longs("lid")
FORMAT = StructType([StructField("pid", LongType()), StructField("score", DoubleType())])
EXTRA_PATIENTS = _longs("pid", "first_day")

# Columns that may be missing, as no result depends on them.
OPTIONAL = {"start_time", "activity1", "activity2", "rlid"}

# Table name -> schema, under the names the callers use for their files.
TABLES = {
    "person": PERSON,
    "household": HOUSEHOLD,
    "residence_location": RESIDENCE,
    "activity_location": PLACE,
    "activity_location_assignment": VISITS,
    "population_network": NETWORK,
    "disease_outcome_training": DISEASE,
}
