"""Standing exposure of susceptible people, kept up to date from day to day.

For people outside the cohort a look-back window ends on one day for all of
them, and only the infected intervals they are linked to matter. So what is
kept is, for every such person, the links to infected people summed per
interval of illness: from contacts (with the side of the list on which the
person stands), from places and from households. Any day's exposure is read off
these sums. When patients are added, only the links of these patients are
followed, their sums are added, and their own rows leave; intervals that no
later window can reach are dropped. The contact list and the visits are summed
once and never shuffled as a whole again.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contagia.functions.joins import spread_join
from contagia.operators import exposure, lags
from contagia.plans import master
from contagia.sources.workspace import Workspace

INTERVAL = ("first_day", "last_day")


def contact_sums(pairs: DataFrame, infected: DataFrame) -> DataFrame:
    """(pid, side, first_day, last_day, n): contacts of everybody with the infected, per interval."""
    ends = F.array(*(F.struct(F.lit(side).alias("side"), F.col(me).alias("subject"), F.col(other).alias("pid"))
                     for side, me, other in ((1, "pid1", "pid2"), (2, "pid2", "pid1"))))
    seen = pairs.select(F.explode(ends).alias("e"), "total_interactions").select("e.*", "total_interactions")
    met = spread_join(seen, infected.select("pid", *INTERVAL), ["pid"], ["subject"])
    return met.groupBy(F.col("subject").alias("pid"), "side", *INTERVAL).agg(F.sum("total_interactions").alias("n"))


def shared_sums(links: DataFrame, infected: DataFrame) -> DataFrame:
    """(pid, first_day, last_day, n): meetings of everybody with the infected at shared keys, per interval.

    Own links are not taken off, since people of the cohort are no subjects."""
    sick = spread_join(links.select("pid", "key", "m"), infected.select("pid", *INTERVAL), ["pid"], ["key"])
    lookup = sick.groupBy("key", *INTERVAL).agg(F.sum("m").alias("there"))
    met = spread_join(links.select("pid", "key", "m"), lookup, ["key"], ["pid"])
    return met.groupBy("pid", *INTERVAL).agg(F.sum(F.col("m") * F.col("there")).alias("n"))


@dataclass(frozen=True)
class Standing:
    """The sums of one day, all stored."""

    person: DataFrame
    pairs: DataFrame
    places: DataFrame
    households: DataFrame
    contact: DataFrame
    place: DataFrame
    household: DataFrame
    window: int

    @classmethod
    def start(cls, tables: Mapping[str, DataFrame], intervals: DataFrame, window: int, first_end: int, last_end: int,
              workspace: Workspace) -> Standing:
        """From a whole cohort, for windows that end between two days."""
        person = tables["person"]
        pairs = workspace.durable(exposure.contact_pairs(tables["population_network"]), "pairs")
        places = workspace.durable(exposure.place_links(tables["activity_location_assignment"]), "places")
        households = exposure.household_links(person)
        reached = intervals.where((F.col("last_day") >= first_end - window) & (F.col("first_day") <= last_end))
        sums = (contact_sums(pairs, reached), shared_sums(places, reached), shared_sums(households, reached))
        kept = (s.join(intervals.select("pid"), "pid", "left_anti") for s in sums)
        stored = (workspace.durable(s, f"sums-{name}") for s, name in zip(kept, ("contact", "place", "household")))
        return cls(person, pairs, places, households, *stored, window)

    def after(self, patients: DataFrame, first_end: int, workspace: Workspace) -> Standing:
        """With further patients (pid, first_day, last_day), for windows that end on `first_end` or later."""
        more = (contact_sums(self.pairs, patients), shared_sums(self.places, patients), shared_sums(self.households, patients))
        names = ("contact", "place", "household")
        stored = [
            workspace.durable(
                old.where(F.col("last_day") >= first_end - self.window).unionByName(new)
                .join(patients.select("pid").distinct(), "pid", "left_anti"), f"sums-{name}")
            for old, new, name in zip((self.contact, self.place, self.household), more, names)
        ]
        return Standing(self.person, self.pairs, self.places, self.households, *stored, self.window)

    def features(self, end: int) -> DataFrame:
        """Features of everybody outside the cohort for windows that end on `end` (others have none)."""
        met = exposure.merge_sides(exposure.in_window(self.contact.withColumnRenamed("n", "total_interactions"), self.window, end))
        wide = master.LagTables(
            lags.lag_pivot(met, "total_interactions", lags.CONTACT, self.window),
            lags.lag_pivot(exposure.in_window(self.place, self.window, end), "n", lags.PLACE, self.window),
            lags.lag_pivot(exposure.in_window(self.household, self.window, end), "n", lags.HOUSEHOLD, self.window),
        )
        return master.person_features(self.person, wide)
