"""Who was infected, and when.

The state table is the largest input. It is reduced once per person
(`infection_timeline`); every cohort below derives from that one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contagia.functions.joins import dealt, spread_join
from contagia.params import RunParams


def infection_timeline(states: DataFrame) -> DataFrame:
    """Per person: first and last infectious day, first recovered day, and the
    first recovered day that is not before the first infectious one.

    Minima and maxima per person, so each task sends one row of fixed width for
    a person. Only people who recovered before they fell ill need a second
    look at their later recovered days.
    """
    infectious = F.when(F.col("state") == "I", F.col("day"))
    recovered = F.when(F.col("state") == "R", F.col("day"))
    per_person = (
        states.where(F.col("state").isin("I", "R"))
        .groupBy("pid")
        .agg(
            F.min(infectious).alias("first_infected"),
            F.max(infectious).alias("last_infected"),
            F.min(recovered).alias("first_recovered"),
        )
    )
    early = per_person.where("first_recovered < first_infected").select("pid", "first_infected")
    # a left join, and no filter that would make it an inner one: the states must never be the broadcast side,
    # since the planner takes them for much smaller than they are when they come out of an explode
    again = (
        dealt(states.where("state = 'R' AND pid IS NOT NULL").select("pid", "day"), "pid")
        .join(early, "pid", "left")
        .groupBy("pid").agg(F.min(F.when(F.col("day") >= F.col("first_infected"), F.col("day"))).alias("_later"))
        .where(F.col("_later").isNotNull())
    )
    after = F.when(F.col("first_recovered") >= F.col("first_infected"), F.col("first_recovered"))
    return per_person.join(again, "pid", "left").select(
        "pid", "first_infected", "last_infected", "first_recovered",
        F.coalesce(after, "_later").alias("recovered_after"),
    )


def _is_recovered(params: RunParams):
    end = params.fixed_ending
    known = (F.col("first_infected") <= end) & (F.col("recovered_after") <= end)
    return F.coalesce(known, F.lit(False))


def recovered_timeline(timeline: DataFrame, params: RunParams) -> DataFrame:
    """People seen to fall ill and recover up to the fixed ending."""
    return timeline.where(_is_recovered(params)).select(
        "pid",
        F.col("recovered_after").alias("last_day"),
        F.col("first_infected").alias("first_day"),
    )


def asymptomatic_timeline(timeline: DataFrame, params: RunParams) -> DataFrame:
    """People who recovered up to the fixed ending without a complete illness on record."""
    return timeline.where(
        ~_is_recovered(params) & (F.col("first_recovered") <= params.fixed_ending)
    ).select("pid", F.col("first_recovered").alias("last_day"))


def recovery_features(person: DataFrame, cohort: DataFrame) -> DataFrame:
    """Cohort members with the features of the recovery-time model.

    The household size counts cohort members only. It is aggregated per
    household and joined back, so a huge household is combined map-side and
    its members are spread over tasks.
    """
    members = person.join(cohort, "pid")
    size = members.groupBy("hid").agg(F.max("person_number").alias("total_family_members"))
    joined = spread_join(members, size, ["hid"], ["pid"])
    base = ["pid", "sex", "age", "person_number", "total_family_members"]
    if "first_day" in cohort.columns:
        return joined.select(*base, (F.col("last_day") - F.col("first_day")).alias("recovery_time"))
    return joined.select(*base, "last_day")


def backdate(asymptomatic: DataFrame, days: int = 2) -> DataFrame:
    """First day of asymptomatic people when no recovery model can be fitted."""
    return asymptomatic.select("pid", (F.col("last_day") - days).alias("first_day"), "last_day")


def merge_cohorts(timeline: DataFrame, backdated: DataFrame, params: RunParams) -> DataFrame:
    """Symptomatic (sym=1) and asymptomatic (sym=0) people infected up to the fixed ending.

    The last day of a symptomatic person is the last infectious day on record.
    Each input has one row per person and `sym` differs, so the set union is a
    plain union.
    """
    end = params.fixed_ending
    symptomatic = timeline.where(F.col("first_infected") <= end).select(
        "pid",
        F.col("first_infected").alias("first_day"),
        F.col("last_infected").alias("last_day"),
        F.lit(1).cast("long").alias("sym"),
    )
    silent = backdated.where(F.col("first_day") <= end).select(
        "pid", "first_day", "last_day", F.lit(0).cast("long").alias("sym")
    )
    return symptomatic.unionByName(silent)


def add_predicted(cohort: DataFrame, extra: DataFrame, params: RunParams) -> DataFrame:
    """Add predicted patients (sym=2) who are not in the cohort yet."""
    predicted = (
        extra.select(
            "pid",
            "first_day",
            (F.col("first_day") + params.look_forward).alias("last_day"),
            F.lit(2).cast("long").alias("sym"),
        )
        .distinct()
        .join(cohort.select("pid"), "pid", "left_anti")
    )
    return cohort.unionByName(predicted)


def infection_intervals(cohort: DataFrame) -> DataFrame:
    """Distinct infection intervals; a person may have two."""
    return cohort.select("pid", "first_day", "last_day").distinct()


def constant_cohort(timeline: DataFrame, params: RunParams, days: int = 2) -> DataFrame:
    """`merge_cohorts` with constant backdating, as a projection of the timeline.

    Both intervals of a person come from the same row: no union of two reads
    of the states, and the result stays partitioned by person.
    """
    end = params.fixed_ending
    symptomatic = F.when(
        F.col("first_infected") <= end, _interval("first_infected", "last_infected", 1)
    )
    silent = F.when(
        ~_is_recovered(params)
        & (F.col("first_recovered") <= end)
        & (F.col("first_recovered") - days <= end),
        _interval(F.col("first_recovered") - days, "first_recovered", 0),
    )
    both = F.array_compact(F.array(symptomatic, silent))
    return timeline.select("pid", F.explode(both).alias("i")).select("pid", "i.*")


def _interval(first: Column | str, last: Column | str, sym: int) -> Column:
    first = F.col(first) if isinstance(first, str) else first
    return F.struct(
        first.alias("first_day"), F.col(last).alias("last_day"), F.lit(sym).cast("long").alias("sym")
    )


def study_cohort(timeline: DataFrame, params: RunParams, extra: DataFrame | None = None,
                 backdated: DataFrame | None = None) -> DataFrame:
    """The cohort of a run, before intervals are made distinct."""
    if backdated is None:
        merged = constant_cohort(timeline, params)
    else:
        merged = merge_cohorts(timeline, backdated, params)
    return merged if extra is None else add_predicted(merged, extra, params)


def susceptible(person: DataFrame, intervals: DataFrame, params: RunParams,
                inference: bool = False) -> DataFrame:
    """People outside the cohort, with their fixed look-back window."""
    end = params.inference_window_end if inference else params.training_window_end
    return (
        person.select("pid")
        .join(intervals.select("pid"), "pid", "left_anti")
        .select(
            "pid",
            F.lit(end).cast("long").alias("last_day"),
            F.lit(end - params.window).cast("long").alias("first_day"),
        )
    )
