"""Exposure of people to infected others: contacts, places, households.

All three share one rule. A subject looks back over [window_end - w, window_end];
an infected person counts when their interval touches that window, and the
touched part [max_end, min_end] is kept (the lower bound is the later of the
two starts, the upper bound the earlier of the two ends).

Places and households could be self-joins whose size is the square of the
largest place. Here the infected side is first summed per place, short block of
days and interval cut to that block. However many people meet at a place, a
block holds at most (b + w)(b + w + 1) / 2 such rows, and each subject is
joined with the rows of one block. Nothing grows with the square of a place,
and a busy place can be split over tasks, since its lookup side stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contagia.functions.joins import pinned, spread_join
from contagia.params import RunParams

BOUNDS = ["pid", "window_end", "max_end", "min_end"]
BLOCK_DAYS = 8  # about the length of an illness: an interval falls into two or three blocks


def _clip(first: Column, last: Column, end: Column, window: int) -> list[Column]:
    return [
        F.greatest(first, end - window).alias("max_end"),
        F.least(last, end).alias("min_end"),
    ]


def _touches(first: Column, last: Column, end: Column, window: int) -> Column:
    return (first <= end) & (last >= end - window)


def with_overlap(exposure: DataFrame) -> DataFrame:
    """Length in days of the touched part."""
    return exposure.withColumn("overlap", F.col("min_end") - F.col("max_end") + 1)


# ---------------------------------------------------------------- contacts


def contact_pairs(network: DataFrame) -> DataFrame:
    """Contacts per pair of people."""
    return network.groupBy("pid1", "pid2").agg(F.count(F.lit(1)).alias("total_interactions"))


def contact_table(network: DataFrame, intervals: DataFrame) -> DataFrame:
    """Contacts per pair, with the infection interval of both ends (null: not infected).

    The edge list is summed per pair before the joins; intervals are distinct,
    so the joins cannot merge groups and no second aggregation is needed.
    """
    pairs = contact_pairs(network)
    for end, far in (("pid1", "pid2"), ("pid2", "pid1")):
        side = intervals.select(
            F.col("pid").alias(end),
            F.col("first_day").alias(f"first_dat_{end}"),
            F.col("last_day").alias(f"last_dat_{end}"),
        )
        pairs = spread_join(pairs, side, [end], [far], "left", shuffled=True)
    return pairs.select(
        "pid1", "pid2", "first_dat_pid1", "last_dat_pid1", "first_dat_pid2", "last_dat_pid2",
        "total_interactions",
    )


def _contact_terms(contacts: DataFrame, window: int, fixed_end: int | None,
                   infected: bool, uninfected: bool, sides: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Contacts of one end (the subject) with an infected other end, seen from each side.

    The window of an infected subject ends on their own first day, that of an
    uninfected one on the fixed end, so both kinds come out of one pass.
    """
    def seen_from(side: int) -> Column:
        me, other = ("pid1", "pid2") if side == 1 else ("pid2", "pid1")
        return F.struct(
            F.lit(side).alias("side"),
            F.col(me).alias("pid"),
            F.col(f"first_dat_{me}").alias("own_first"),
            F.col(f"first_dat_{other}").alias("first_day"),
            F.col(f"last_dat_{other}").alias("last_day"),
        )

    some_infected = F.col("first_dat_pid1").isNotNull() | F.col("first_dat_pid2").isNotNull()
    ends = contacts.where(some_infected).select(
        F.explode(F.array(*[seen_from(side) for side in sides])).alias("e"), "total_interactions"
    )
    own, first, last = F.col("e.own_first"), F.col("e.first_day"), F.col("e.last_day")
    if infected and uninfected:
        end, wanted = F.coalesce(own, F.lit(fixed_end).cast("long")), F.lit(True)
    elif infected:
        end, wanted = own, own.isNotNull()
    else:
        end, wanted = F.lit(fixed_end).cast("long"), own.isNull()
    return ends.where(wanted & _touches(first, last, end, window)).select(
        "e.side", "e.pid", end.alias("window_end"), *_clip(first, last, end, window),
        "total_interactions",
    )


def contact_side(contacts: DataFrame, side: int, window: int, fixed_end: int | None = None) -> DataFrame:
    """Exposure of the people stored as pid1 (side 1) or pid2 (side 2).

    Infected subjects by default; with a fixed window end, uninfected ones.
    """
    infected = fixed_end is None
    return (
        _contact_terms(contacts, window, fixed_end, infected, not infected, (side,))
        .groupBy(*BOUNDS)
        .agg(F.sum("total_interactions").alias("total_interactions"))
    )


def merge_sides(terms: DataFrame) -> DataFrame:
    """Exposure over both ends, from terms of each `side`.

    The two sides merge as sets: when both give the same person, window,
    bounds and sum, that row counts once. Both sums are taken in one
    aggregation and compared, instead of a distinct over a union.
    """
    n = F.col("total_interactions")
    sums = terms.groupBy(*BOUNDS).agg(
        F.sum(F.when(F.col("side") == 1, n)).alias("_one"),
        F.sum(F.when(F.col("side") == 2, n)).alias("_two"),
    )
    merged = F.when(F.col("_one") == F.col("_two"), F.col("_one")).otherwise(
        F.coalesce("_one", F.lit(0)) + F.coalesce("_two", F.lit(0))
    )
    return sums.select(*BOUNDS, merged.alias("total_interactions"))


def _merged_sides(contacts: DataFrame, window: int, fixed_end: int | None,
                  infected: bool, uninfected: bool) -> DataFrame:
    return merge_sides(_contact_terms(contacts, window, fixed_end, infected, uninfected))


def contact_exposure(contacts: DataFrame, window: int, fixed_end: int | None = None) -> DataFrame:
    """Exposure of infected people, or of uninfected ones when a fixed window end is given."""
    return _merged_sides(contacts, window, fixed_end, fixed_end is None, fixed_end is not None)


def all_contact_exposure(contacts: DataFrame, params: RunParams) -> DataFrame:
    """Exposure of everybody. A person is infected or not, so the two kinds never mix in a group."""
    return _merged_sides(contacts, params.window, params.training_window_end, True, True)


# ------------------------------------------------- shared places (any key)


def place_links(visits: DataFrame) -> DataFrame:
    """Visits summed per person and place: `m` visits of `d` minutes in all (null counts as 0)."""
    minutes = F.coalesce("duration", F.lit(0))
    summed = visits.groupBy("pid", F.col("lid").alias("key")).agg(
        F.count(F.lit(1)).alias("m"), F.sum(minutes).alias("d")
    )
    return pinned(summed, "m", "d")


def household_links(person: DataFrame) -> DataFrame:
    """Each person belongs to one household once."""
    one = F.lit(1).cast("long")
    return person.select("pid", F.col("hid").alias("key"), one.alias("m"), one.alias("d"))


def _cut(first: Column, last: Column, block: Column, window: int) -> list[Column]:
    """An interval cut to [block start - w, block end].

    For windows that end in the block this changes nothing, and it leaves few
    distinct intervals per block.
    """
    start = block * BLOCK_DAYS
    return [
        F.greatest(first, start - window).alias("first_day"),
        F.least(last, start + (BLOCK_DAYS - 1)).alias("last_day"),
    ]


_OTHERS = "map<struct<first_day:bigint,last_day:bigint>,bigint>"


def infected_windows(intervals: DataFrame, window: int) -> DataFrame:
    """Infected people look back from their own first day.

    own_last is the last day of that illness. `others` counts the person's
    further intervals, as cut to the block of the window; it is null for nearly
    everybody, since a cohort holds one or two intervals per person.
    """
    first, last = F.col("own.first_day"), F.col("own.last_day")
    block = F.floor(first / BLOCK_DAYS)
    every = intervals.groupBy("pid").agg(
        F.collect_list(F.struct("first_day", "last_day")).alias("every")
    )
    cuts = F.transform(
        F.filter("every", lambda i: (i != F.col("own")) & (i["last_day"] + window >= i["first_day"])),
        lambda i: F.struct(*_cut(i["first_day"], i["last_day"], block, window)),
    )
    kinds = F.array_distinct("cuts")
    counts = F.transform(kinds, lambda k: F.size(F.filter("cuts", lambda c: c == k)).cast("long"))
    return (
        every.withColumn("own", F.explode("every"))
        .withColumn("cuts", cuts)
        .select(
            "pid", first.alias("window_end"), last.alias("own_last"),
            F.when(F.size("every") > 1, F.map_from_arrays(kinds, counts)).cast(_OTHERS).alias("others"),
        )
    )


def fixed_windows(people: DataFrame) -> DataFrame:
    """Susceptible people look back from the end of their fixed window; no own illness."""
    none = F.lit(None)
    return people.select(
        "pid", F.col("last_day").alias("window_end"),
        none.cast("long").alias("own_last"), none.cast(_OTHERS).alias("others"),
    )


def _infections_per_key(links: DataFrame, intervals: DataFrame, window: int) -> DataFrame:
    """Infected links summed per key, block of window ends, and cut interval."""
    reach = F.col("last_day") + window
    blocks = F.sequence(F.floor(F.col("first_day") / BLOCK_DAYS), F.floor(reach / BLOCK_DAYS))
    cut = (
        intervals.where(reach >= F.col("first_day"))
        .withColumn("block", F.explode(blocks))
        .select("pid", "block", *_cut(F.col("first_day"), F.col("last_day"), F.col("block"), window))
    )
    return (
        spread_join(links, cut, ["pid"], ["key"], shuffled=True)
        .groupBy("key", "block", "first_day", "last_day")
        .agg(F.sum("m").alias("n"), F.sum("d").alias("total_d"))
    )


def _own_share(window: int) -> Column:
    """How many of the subject's own intervals went into the lookup row."""
    row = [F.col("first_day"), F.col("last_day")]
    first, last = _cut(F.col("window_end"), F.col("own_last"), F.col("block"), window)
    this = F.col("own_last").isNotNull() & (row[0] == first) & (row[1] == last)
    more = F.try_element_at(F.col("others"), F.struct(*row))
    return F.when(this, 1).otherwise(0) + F.coalesce(more, F.lit(0))


def shared_terms(links: DataFrame, intervals: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    """Exposure terms (n meetings, d minutes) of the subjects in `windows`.

    Equality on key and block, then the interval test against the few distinct
    intervals of the block. A lookup row into which the subject's own links
    went is reduced by them before it is used.
    """
    first, last, end = F.col("first_day"), F.col("last_day"), F.col("window_end")
    lookup = _infections_per_key(links, intervals, window)
    subjects = spread_join(links, windows, ["pid"], ["key"], shuffled=True).withColumn(
        "block", F.floor(end / BLOCK_DAYS)
    )
    return (
        subjects.join(lookup, ["key", "block"])
        .where(_touches(first, last, end, window))
        .withColumn("own", _own_share(window))
        .select(
            "pid", "window_end", *_clip(first, last, end, window),
            (F.col("m") * (F.col("n") - F.col("m") * F.col("own"))).alias("n"),
            (F.col("m") * (F.col("total_d") - F.col("d") * F.col("own"))).alias("d"),
        )
        .where(F.col("n") > 0)
    )


def fixed_terms(links: DataFrame, intervals: DataFrame, people: DataFrame, window: int,
                fixed_end: int) -> DataFrame:
    """Exposure terms of uninfected people whose windows all end on one day.

    Only infections that touch this window take part, already clipped, so a
    key has at most (w + 1)(w + 2) / 2 lookup rows and no interval test is left.
    """
    end = F.lit(fixed_end).cast("long")
    first, last = F.col("first_day"), F.col("last_day")
    current = intervals.where(_touches(first, last, end, window)).select(
        "pid", *_clip(first, last, end, window)
    )
    infected = spread_join(links, current, ["pid"], ["key"], shuffled=True)
    lookup = infected.groupBy("key", "max_end", "min_end").agg(
        F.sum("m").alias("n"), F.sum("d").alias("total_d")
    )
    subjects = spread_join(links, people.select("pid"), ["pid"], ["key"], "left_semi", shuffled=True)
    return subjects.select("pid", "key", "m").join(lookup, "key").select(
        "pid", end.alias("window_end"), "max_end", "min_end",
        (F.col("m") * F.col("n")).alias("n"), (F.col("m") * F.col("total_d")).alias("d"),
    )


def in_window(infected: DataFrame, window: int, fixed_end: int) -> DataFrame:
    """Rows with an interval (first_day, last_day) that touches one fixed window, clipped to it."""
    end, first, last = F.lit(fixed_end).cast("long"), F.col("first_day"), F.col("last_day")
    rest = [c for c in infected.columns if c not in ("first_day", "last_day")]
    return infected.where(_touches(first, last, end, window)).select(*rest, end.alias("window_end"), *_clip(first, last, end, window))


def exposure_table(terms: DataFrame) -> DataFrame:
    return terms.groupBy(*BOUNDS).agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def place_exposure(terms: DataFrame) -> DataFrame:
    return exposure_table(terms).select(
        *BOUNDS, F.col("n").alias("total_interaction"), F.col("d").alias("sum_infected_duration")
    )


def household_exposure(terms: DataFrame) -> DataFrame:
    return exposure_table(terms).select(*BOUNDS, F.col("n").alias("family_infected"))


def visits_with_interval(visits: DataFrame, cohort: DataFrame) -> DataFrame:
    """Visits of cohort members with their interval (or look-back window)."""
    joined = spread_join(visits, cohort, ["pid"], ["lid"], shuffled=True)
    return joined.select(*visits.columns, "first_day", "last_day")


def place_totals(visits: DataFrame) -> DataFrame:
    """Per person: visits and hours of everybody at the places the person visits.

    A place visited several times counts each time, so visits are summed per
    person and place first and weighted.
    """
    links = place_links(visits)
    totals = links.groupBy("key").agg(
        F.sum(F.when(F.col("pid").isNotNull(), F.col("m"))).alias("total_loc"),
        (F.sum("d") / 60).alias("total_interaction_loc"),
    )
    links = links.select("pid", "key", "m")
    return (
        spread_join(links, totals, ["key"], ["pid"])
        .groupBy("pid")
        .agg(
            F.sum(F.col("m") * F.col("total_loc")).alias("total_loc"),
            F.sum(F.col("m") * F.col("total_interaction_loc")).alias("total_interaction_loc"),
        )
    )
