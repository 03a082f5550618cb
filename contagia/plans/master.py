"""The windowed feature build, from input tables to labelled frames."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from contagia.operators import cohort, exposure, labels, lags
from contagia.params import RunParams
from contagia.sources.workspace import Workspace

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class LagTables:
    """One wide row per exposed person, for each of the three exposures."""

    contact: DataFrame
    place: DataFrame
    household: DataFrame


def contact_lags(tables: Tables, intervals: DataFrame, params: RunParams,
                 inference: bool = False) -> DataFrame:
    contacts = exposure.contact_table(tables["population_network"], intervals)
    if inference:
        rows = exposure.contact_exposure(contacts, params.window, params.inference_window_end)
    else:
        rows = exposure.all_contact_exposure(contacts, params)
    return lags.lag_pivot(rows, "total_interactions", lags.CONTACT, params.window)


def _shared_lags(links: DataFrame, tables: Tables, intervals: DataFrame, params: RunParams,
                 name: str, inference: bool) -> DataFrame:
    """Lags straight from the exposure terms, without the exposure table in between."""
    people = cohort.susceptible(tables["person"], intervals, params, inference)
    if inference:
        terms = exposure.fixed_terms(
            links, intervals, people, params.window, params.inference_window_end
        )
    else:
        windows = exposure.infected_windows(intervals, params.window).unionByName(exposure.fixed_windows(people))
        terms = exposure.shared_terms(links, intervals, windows, params.window)
    return lags.lag_pivot(terms, "n", name, params.window)


def place_lags(tables: Tables, intervals: DataFrame, params: RunParams,
               inference: bool = False) -> DataFrame:
    links = exposure.place_links(tables["activity_location_assignment"])
    return _shared_lags(links, tables, intervals, params, lags.PLACE, inference)


def household_lags(tables: Tables, intervals: DataFrame, params: RunParams,
                   inference: bool = False) -> DataFrame:
    links = exposure.household_links(tables["person"])
    return _shared_lags(links, tables, intervals, params, lags.HOUSEHOLD, inference)


def lag_tables(tables: Tables, intervals: DataFrame, params: RunParams,
               inference: bool = False) -> LagTables:
    return LagTables(
        contact_lags(tables, intervals, params, inference),
        place_lags(tables, intervals, params, inference),
        household_lags(tables, intervals, params, inference),
    )


def feature_columns(params: RunParams) -> list[str]:
    """Model features, in table order."""
    names = ["age", "sex"]
    for base in (lags.CONTACT, lags.PLACE, lags.HOUSEHOLD):
        names += lags.lag_columns(base, params.window)
    return names


def person_features(person: DataFrame, wide: LagTables) -> DataFrame:
    """One row per person; null lags mean no exposure. All joins share one partitioning on pid."""
    frame = person.select("pid", "age", "sex")
    for table in (wide.contact, wide.place, wide.household):
        frame = frame.join(table, "pid", "left")
    return frame


def labelled(features: DataFrame, label_set: DataFrame) -> DataFrame:
    return features.join(label_set, "pid")


class StudyFrames:
    """The frames one feature build can return; each is declared when first asked for.

    With a workspace the timeline and the cohort, which nearly every step
    reads, are written once to shared storage; later joins then know their
    true size.
    """

    def __init__(self, tables: Tables, params: RunParams, extra: DataFrame | None = None,
                 backdated: DataFrame | None = None, workspace: Workspace | None = None,
                 timeline: DataFrame | None = None) -> None:
        self.tables, self.params = tables, params
        workspace = workspace.fresh("study") if workspace is not None else None
        if timeline is None:
            timeline = cohort.infection_timeline(tables["disease_outcome_training"])
            if workspace is not None:
                timeline = workspace.durable(timeline, "timeline")
        intervals = cohort.infection_intervals(
            cohort.study_cohort(timeline, params, extra, backdated)
        )
        if workspace is not None:
            intervals = workspace.durable(intervals, "intervals")
        self.timeline, self.intervals = timeline, intervals

    @cached_property
    def people(self) -> DataFrame:
        return cohort.susceptible(self.tables["person"], self.intervals, self.params)

    @cached_property
    def current(self) -> DataFrame:
        return labels.positives_on_day(self.timeline, self.params.end_day)

    def features(self, inference: bool = False) -> DataFrame:
        wide = lag_tables(self.tables, self.intervals, self.params, inference)
        return person_features(self.tables["person"], wide)

    @cached_property
    def training(self) -> DataFrame:
        return labelled(
            self.features(), labels.training_labels(self.intervals, self.people, self.params)
        )

    @cached_property
    def testing(self) -> DataFrame:
        return labelled(
            self.features(), labels.testing_labels(self.intervals, self.people, self.current)
        )

    @cached_property
    def inference(self) -> DataFrame:
        return labelled(self.features(inference=True), labels.inference_set(self.people, self.current))


def study_data(tables: Tables, params: RunParams, extra: DataFrame | None = None,
               backdated: DataFrame | None = None, workspace: Workspace | None = None):
    """The training frame, or (testing, inference) when not training."""
    frames = StudyFrames(tables, params, extra, backdated, workspace)
    if params.is_training:
        return frames.training
    return frames.testing, frames.inference
