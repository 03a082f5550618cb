"""The flat feature set: three counts per person, whole population or per client.

Every function takes `client`, a tuple with the client column or empty. With a
client column, one job builds the features of all clients, each from its own
rows only.

Statuses are attached to the two ends of each contact once, and both feature
kinds (infected people: onset order; others: recent cases) come out of the
same pass over the contacts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contagia.functions.joins import dealt, pinned, spread_join
from contagia.params import RunParams
from contagia.sources.tables import network_edges
from contagia.sources.workspace import Workspace

Client = tuple[str, ...]
ILL = ("I", "R")
FLAT_FEATURES = ["total_pat", "infect_pat", "loc_infect_pat", "age", "sex", "family_infect"]


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0).cast("long")


# ------------------------------------------------------------ person status


def affected_cohort(states: DataFrame, params: RunParams, client: Client = ()) -> DataFrame:
    """First ill day per person, looking at days from window - 1 on."""
    return (
        states.where((F.col("day") >= params.window - 1) & F.col("state").isin(*ILL))
        .groupBy(*client, "pid")
        .agg(F.min("day").alias("day"))
    )


def _recently_ill(params: RunParams) -> Column:
    low = params.fixed_ending - 2 * params.window
    high = params.end_day - params.window
    return (F.col("day") >= low) & (F.col("day") < high)


def person_infection_flag(person: DataFrame, states: DataFrame, params: RunParams,
                          client: Client = ()) -> DataFrame:
    """infect=1 for people ill on some day of the recent window, else 0."""
    keys = [*client, "pid"]
    recent = (
        states.where(F.col("state").isin(*ILL) & _recently_ill(params))
        .select(*keys)
        .distinct()
        .withColumn("_recent", F.lit(True))
    )
    return person.select(*keys).join(recent, keys, "left").select(
        *keys, _flag(F.col("_recent").isNotNull()).alias("infect")
    )


def person_status(person: DataFrame, states: DataFrame, params: RunParams,
                  client: Client = ()) -> DataFrame:
    """All a contact needs to know about one end, from one aggregation of the states.

    day:    first ill day from window - 1 on (null: none)
    ever:   1 if ill on any day
    infect: 1 / 0 for known people, null for ends missing in `person`
    """
    keys = [*client, "pid"]
    history = states.where(F.col("state").isin(*ILL)).groupBy(*keys).agg(
        F.min(F.when(F.col("day") >= params.window - 1, F.col("day"))).alias("day"),
        F.max(_flag(_recently_ill(params))).alias("_recent"),
    )
    known = person.select(*keys).withColumn("_known", F.lit(True))
    joined = known.join(history.withColumn("_ever", F.lit(True)), keys, "full")
    return joined.select(
        *keys,
        "day",
        _flag(F.col("_ever").isNotNull()).alias("ever"),
        F.when(F.col("_known"), F.coalesce("_recent", F.lit(0).cast("long"))).alias("infect"),
    )


def _attach(edges: DataFrame, status: DataFrame, columns: list[str], client: Client) -> DataFrame:
    """Attach status columns to both ends, as <column>_p1 and <column>_p2."""
    for number, end, far in ((1, "pid1", "pid2"), (2, "pid2", "pid1")):
        renamed = status.select(
            *client, F.col("pid").alias(end), *[F.col(c).alias(f"{c}_p{number}") for c in columns]
        )
        edges = spread_join(edges, renamed, [*client, end], [far, "lid"], "left", shuffled=True)
    return edges


# ----------------------------------------------------------- contact flags


def edge_days(network: DataFrame, affected: DataFrame, client: Client = ()) -> DataFrame:
    """Distinct contacts with the first ill day of both ends; -1 where there is none."""
    joined = _attach(network_edges(network, client), affected, ["day"], client)
    never = F.lit(-1).cast("long")
    return joined.select(
        *client, "pid1", "pid2", "lid",
        F.coalesce("day_p1", never).alias("day_p1"), F.coalesce("day_p2", never).alias("day_p2"),
    )


def _infected_by(giver: str, taker: str, window: int) -> Column:
    """The giver was ill 1..window days before the taker."""
    gap = F.col(taker) - F.col(giver)
    return _flag((F.col(giver) >= 0) & (gap > 0) & (gap <= window))


def transmission_flags(days: DataFrame, window: int) -> DataFrame:
    """infect_p1 / infect_p2: was this end ill shortly before the other one?"""
    return days.select(
        *days.columns,
        _infected_by("day_p2", "day_p1", window).alias("infect_p2"),
        _infected_by("day_p1", "day_p2", window).alias("infect_p1"),
    )


def recent_flags(network: DataFrame, flags: DataFrame, client: Client = ()) -> DataFrame:
    """Distinct contacts with the recent-case flag of both ends (null: unknown person)."""
    joined = _attach(network_edges(network, client), flags, ["infect"], client)
    return joined.select(*client, "pid1", "pid2", "lid", "infect_p1", "infect_p2")


# -------------------------------------------------------------- aggregates


def _both_ends(flagged: DataFrame, client: Client, kinds: tuple[str, ...] = ("",)) -> DataFrame:
    """Each contact seen from either end: own and other flag per kind."""
    def end(number: int, other: int) -> Column:
        fields = [F.col(f"pid{number}").alias("pid"), F.lit(number).alias("side")]
        for kind in kinds:
            fields.append(F.col(f"infect{kind}_p{number}").alias(f"own{kind}"))
            fields.append(F.col(f"infect{kind}_p{other}").alias(f"other{kind}"))
        return F.struct(*fields)

    rows = flagged.select(*client, "lid", F.explode(F.array(end(1, 2), end(2, 1))).alias("e"))
    return rows.select(*client, "lid", "e.*")


def contact_counts(flagged: DataFrame, client: Client = ()) -> DataFrame:
    """Per person: contacts, and contacts whose other end was ill."""
    return _both_ends(flagged, client).groupBy(*client, "pid").agg(
        F.count("own").alias("total_pat"), _or_zero(F.sum("other")).alias("infect_pat")
    )


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast("long"))


def _place_people(ends: DataFrame, client: Client, kinds: tuple[str, ...]) -> DataFrame:
    """One row per person and place: contacts there, ill others, and own illness by side."""
    aggregates, names = [], []
    for kind in kinds:
        own, side = F.col(f"own{kind}"), F.col("side")
        parts = {
            f"met{kind}": F.count(own),
            f"hit{kind}": _or_zero(F.sum(f"other{kind}")),
            f"ill{kind}": _or_zero(F.max(F.when(side == 1, own)))
            + _or_zero(F.max(F.when(side == 2, own))),
        }
        aggregates += [value.alias(name) for name, value in parts.items()]
        names += parts
    keys = [*client, "lid", "pid"]
    return pinned(dealt(ends, *keys).groupBy(*keys).agg(*aggregates), *names)


def _place_sums(people: DataFrame, client: Client, kinds: tuple[str, ...]) -> DataFrame:
    return people.groupBy(*client, "lid").agg(
        *[F.sum(f"ill{kind}").alias(f"loc_infect_pat{kind}") for kind in kinds]
    )


def place_infections(flagged: DataFrame, client: Client = ()) -> DataFrame:
    """Ill people per place. Somebody ill on both sides of the list counts on each."""
    people = _place_people(_both_ends(flagged, client), client, ("",))
    return _place_sums(people, client, ("",))


def _contact_features(ends: DataFrame, client: Client, kinds: tuple[str, ...],
                      workspace: Workspace | None = None) -> DataFrame:
    """All three counts per person and kind.

    The table of people and places serves twice: summed per place, and joined
    with these sums, then summed per person. With a workspace both tables are
    written, so that the shuffles of only one of these steps are on disk.
    """
    people = _place_people(ends, client, kinds)
    if workspace is not None:
        people = workspace.durable(people, "place-people")
    sums = _place_sums(people, client, kinds)
    if workspace is not None:
        sums = workspace.durable(sums, "place-sums")
    # a row per place, in well compressed files once written
    joined = spread_join(people, sums, [*client, "lid"], ["pid"], shuffled=workspace is not None)
    sums = []
    for kind in kinds:
        sums += [
            F.sum(f"met{kind}").alias(f"total_pat{kind}"),
            F.sum(f"hit{kind}").alias(f"infect_pat{kind}"),
            F.sum(f"loc_infect_pat{kind}").alias(f"loc_infect_pat{kind}"),
        ]
    return joined.groupBy(*client, "pid").agg(*sums)


def person_place_infections(flagged: DataFrame, client: Client = ()) -> DataFrame:
    """Per person: ill people over the distinct places of the person's contacts."""
    return _features(flagged, client).select(*client, "pid", "loc_infect_pat")


def _features(flagged: DataFrame, client: Client) -> DataFrame:
    return _contact_features(_both_ends(flagged, client), client, ("",))


def infected_features(network: DataFrame, states: DataFrame, params: RunParams,
                      client: Client = ()) -> DataFrame:
    """Features of people with an ill day, from the order of onsets along contacts."""
    affected = affected_cohort(states, params, client)
    flagged = transmission_flags(edge_days(network, affected, client), params.window)
    return _features(flagged, client).join(affected, [*client, "pid"], "left_semi")


def uninfected_features(person: DataFrame, network: DataFrame, states: DataFrame,
                        params: RunParams, client: Client = ()) -> DataFrame:
    """Features of people who are never ill, from recent cases among contacts."""
    flags = person_infection_flag(person, states, params, client)
    flagged = recent_flags(network, flags, client)
    # one row per person, since the planner may broadcast them
    ever = states.where(F.col("state").isin(*ILL)).select(*client, "pid").distinct()
    return _features(flagged, client).join(ever, [*client, "pid"], "left_anti")


# ------------------------------------------------------------ model frame


def flat_frame(person: DataFrame, network: DataFrame, states: DataFrame, params: RunParams,
               client: Client = (), workspace: Workspace | None = None, stepwise: bool = False) -> DataFrame:
    """One row per person: features, label, and the household sum of infect_pat.

    Training: ill people carry the onset features and covid=1, never-ill people
    the recent-case features and covid=0. Testing: never-ill people only.
    Everyone else, including ill people without contacts, is all zero.
    Equal to joining the two feature tables to `person`, in one contact pass.
    With a workspace the status table, which is joined three times, is written
    once and its true size is known to the planner. The contacts with the status
    of both ends are written too, and the shuffles that led to them deleted.
    `stepwise` does the same for the people and sums of the places: less disk
    for two more writes.
    """
    keys = [*client, "pid"]
    status = person_status(person, states, params, client)
    if workspace is not None:
        status = workspace.durable(status, "status")
    edges = _attach(network_edges(network, client), status, ["day", "infect"], client)
    if workspace is not None:
        edges = workspace.durable(edges, "contacts")
    never = F.lit(-1).cast("long")
    days = edges.withColumn("day_p1", F.coalesce("day_p1", never)).withColumn(
        "day_p2", F.coalesce("day_p2", never)
    )
    kinds = ("_onset", "_recent") if params.is_training else ("_recent",)
    flags = [F.col("infect_p1").alias("infect_recent_p1"), F.col("infect_p2").alias("infect_recent_p2")]
    if params.is_training:
        flags += [
            _infected_by("day_p1", "day_p2", params.window).alias("infect_onset_p1"),
            _infected_by("day_p2", "day_p1", params.window).alias("infect_onset_p2"),
        ]
    ends = _both_ends(days.select(*client, "pid1", "pid2", "lid", *flags), client, kinds)
    # nobody is without id below, and an end without id is never ill; both uses of the ends must filter alike to share a shuffle
    ends = ends.where(F.col("pid").isNotNull())
    features = _contact_features(ends, client, kinds, workspace if stepwise else None)
    features = pinned(features, *[c for c in features.columns if c not in keys])

    mine = person.select(*keys, "hid", "age", "sex")
    # a row per person on both sides: the status is well compressed, and the planner would broadcast it by the size of its files
    rows = mine.join(status.select(*keys, "day", "ever").hint("merge"), keys, "left").join(
        features.withColumn("_met", F.lit(True)), keys, "left"
    )
    met = F.col("_met").isNotNull()
    ill = met & F.col("day").isNotNull()
    healthy = met & (F.col("ever") == 0)
    zero = F.lit(0).cast("long")

    def pick(name: str) -> Column:
        value = F.when(healthy, F.col(f"{name}_recent"))
        if params.is_training:
            value = F.when(ill, F.col(f"{name}_onset")).when(healthy, F.col(f"{name}_recent"))
        return F.coalesce(value, zero).alias(name)

    label = _flag(ill) if params.is_training else zero
    picked = rows.select(
        *keys, pick("total_pat"), pick("infect_pat"), pick("loc_infect_pat"),
        label.alias("covid"),
        *[F.coalesce(c, zero).alias(c) for c in ("age", "sex")], F.coalesce("hid", zero).alias("hid"),
    )
    family = picked.groupBy(*client, "hid").agg(F.sum("infect_pat").alias("family_infect"))
    joined = spread_join(picked, family, [*client, "hid"], ["pid"])
    return joined.select(
        *keys, "total_pat", "infect_pat", "loc_infect_pat", "covid", "age", "sex", "family_infect"
    )


# ---------------------------------------------------------------- labels


def true_labels(states: DataFrame, from_day: int = 50, client: Client = ()) -> DataFrame:
    """Infectious days per person from `from_day` on, and whether there was any."""
    return (
        states.where(F.col("day") >= from_day)
        .groupBy(*client, "pid")
        .agg(F.sum(_flag(F.col("state") == "I")).alias("state_int"))
        .withColumn("true_label", _flag(F.col("state_int") >= 1))
    )


def status_on_day(person: DataFrame, states: DataFrame, day: int = 54) -> DataFrame:
    """pid, age, sex and whether the person is infectious on `day`."""
    that_day = states.where(F.col("day") == day).select(
        "pid", _flag(F.col("state") == "I").alias("_ill")
    )
    zero = F.lit(0).cast("long")
    return person.select("pid", "age", "sex").join(that_day, "pid", "left").select(
        "pid", F.coalesce("age", zero).alias("age"), F.coalesce("sex", zero).alias("sex"),
        F.coalesce("_ill", zero).alias("covid"),
    )
