"""Closed-loop forecasting: today's predicted patients are part of tomorrow's cohort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contagia.operators import cohort, labels
from contagia.params import RunParams
from contagia.plans import master, modelling
from contagia.plans.standing import Standing
from contagia.sources.workspace import Workspace


@dataclass(frozen=True)
class DayResult:
    end_day: int
    predictions: DataFrame
    new_patients: DataFrame
    quality: DataFrame


def predicted_patients(scorer: modelling.Scorer, inference: DataFrame, day: int,
                       threshold: float = 0.5) -> DataFrame:
    """People scored at or above the threshold, ill from `day` on."""
    return scorer(inference).where(F.col("score") >= threshold).select(
        "pid", F.lit(day).cast("long").alias("first_day")
    )


def forecast_day(tables: Mapping[str, DataFrame], params: RunParams, scorer: modelling.Scorer,
                 threshold: float = 0.5, extra: DataFrame | None = None,
                 backdated: DataFrame | None = None, workspace: Workspace | None = None,
                 timeline: DataFrame | None = None) -> DayResult:
    """Score the labelled people of the day, judge the scores (average precision, precision,
    recall), and find the patients to add for the next one.

    With a workspace the scores are stored, as they are read several times.
    """
    frames = master.StudyFrames(tables, params, extra, backdated, workspace, timeline)
    predictions = modelling.score_people(scorer, frames.testing, threshold)
    if workspace is not None:
        predictions = workspace.durable(predictions, "predictions")
    return DayResult(
        params.end_day,
        predictions,
        predicted_patients(scorer, frames.inference, params.end_day, threshold),
        modelling.score_quality(predictions, threshold),
    )


def forecast_days(tables: Mapping[str, DataFrame], params: RunParams, scorer: modelling.Scorer,
                  days: Sequence[int], workspace: Workspace, threshold: float = 0.5,
                  backdated: DataFrame | None = None) -> list[DayResult]:
    """One run per day, each with the patients predicted on the days before.

    The cohort only grows by the predicted patients, and all people who are
    scored look back from one day, so the exposure is not built anew: standing
    sums per person take in the new patients. Every day's patients, cohort and
    sums are written to shared storage before the next day starts, so the plan
    does not grow with the number of days.
    """
    if not days:
        return []
    timeline = workspace.durable(
        cohort.infection_timeline(tables["disease_outcome_training"]), "timeline"
    )  # no day changes it
    params = replace(params, is_training=False)
    intervals = workspace.durable(
        cohort.infection_intervals(cohort.study_cohort(timeline, params, None, backdated)), "intervals"
    )
    first_ends = [min(days[i:]) - params.look_forward for i in range(len(days))]
    standing = Standing.start(tables, intervals, params.window, first_ends[0], max(days), workspace)
    results: list[DayResult] = []
    for i, day in enumerate(days):
        step, today = workspace.sub(f"day-{i}-{day}"), replace(params, end_day=day)
        people = cohort.susceptible(tables["person"], intervals, today)
        current = labels.positives_on_day(timeline, day)
        testing = master.labelled(
            standing.features(today.training_window_end), labels.testing_labels(intervals, people, current)
        )
        ahead = master.labelled(
            standing.features(today.inference_window_end), labels.inference_set(people, current)
        )
        predictions = step.durable(modelling.score_people(scorer, testing, threshold), "predictions")
        new_patients = step.durable(predicted_patients(scorer, ahead, day, threshold), "new-patients")
        results.append(DayResult(day, predictions, new_patients, modelling.score_quality(predictions, threshold)))
        if i + 1 < len(days):
            fresh = new_patients.select(
                "pid", "first_day", (F.col("first_day") + params.look_forward).alias("last_day")
            ).distinct()
            intervals = step.durable(intervals.unionByName(fresh), "intervals")
            standing = standing.after(fresh, first_ends[i + 1], step)
    return results
