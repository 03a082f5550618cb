import random

from contagia.operators import flat
from contagia.params import RunParams
from contagia.sources import fixtures
from contagia.sources import tables as tables_io
from contagia.sources.workspace import Workspace
from rows import rows_of

TRAIN = RunParams(window=2, end_day=49, fixed_ending=49)
TEST = RunParams(window=2, end_day=49, fixed_ending=49, is_training=False)
PERSON = "pid long, hid long, person_number long, age long, sex long"
EDGES = "pid1 long, pid2 long, lid long"
STATES = "day long, pid long, state string"
OUT = ["pid", "total_pat", "infect_pat", "loc_infect_pat", "covid", "family_infect"]


def _world(make, seed, clients=0):
    rng = random.Random(seed)
    people = [(p, p // 3, p % 3 + 1, rng.randrange(90), rng.randrange(1, 3)) for p in range(40)]
    # people 40..44 meet others but are not in the person table; 36..39 meet nobody
    edges = [(*rng.sample([*range(36), *range(40, 45)], 2), rng.randrange(6)) for _ in range(150)]
    edges += edges[:10]
    states = []
    for p in range(45):
        onset = rng.randrange(30, 70)
        for day in range(30, 63):
            state = "S" if day < onset else "I" if day < onset + 4 and p % 4 else "R"
            states.append((day, p, state))
    return make(PERSON, people), make(EDGES, edges), make(STATES, states)


def test_frame_equals_joined_feature_tables(make):
    for seed in (1, 2):
        person, edges, states = _world(make, seed)
        onset = {r["pid"]: r for r in flat.infected_features(edges, states, TRAIN).collect()}
        recent = {r["pid"]: r for r in flat.uninfected_features(person, edges, states, TRAIN).collect()}
        assert not set(onset) & set(recent)
        for params, tables in ((TRAIN, [(onset, 1), (recent, 0)]), (TEST, [(recent, 0)])):
            rows, home = {}, {}
            for r in person.collect():
                rows[r["pid"]] = (0, 0, 0, 0)
                home[r["pid"]] = r["hid"]
            for table, label in tables:
                for pid, r in table.items():
                    if pid in rows:
                        rows[pid] = (r["total_pat"], r["infect_pat"], r["loc_infect_pat"], label)
            family = {}
            for pid, r in rows.items():
                family[home[pid]] = family.get(home[pid], 0) + r[1]
            expected = sorted((pid, *r, family[home[pid]]) for pid, r in rows.items())
            got = flat.flat_frame(person, edges, states, params)
            assert rows_of(got.select(*OUT)) == expected


def test_unknown_end_counts_nothing(make):
    person = make(PERSON, [(1, 1, 1, 30, 1)])
    edges = make(EDGES, [(1, 2, 0), (1, 3, 0)])
    states = make(STATES, [(46, 2, "I"), (46, 9, "S")])
    flags = flat.person_infection_flag(person, states, TRAIN)
    flagged = flat.recent_flags(edges, flags)
    # 2 is ill but unknown: no flag, so it neither counts as met nor as ill
    assert rows_of(flat.contact_counts(flagged)) == [(1, 2, 0), (2, 0, 0), (3, 0, 0)]
    assert rows_of(flat.uninfected_features(person, edges, states, TRAIN)) == [(1, 2, 0, 0), (3, 0, 0, 0)]


def test_ill_person_without_contacts_is_labelled_zero(make):
    person = make(PERSON, [(1, 1, 1, 30, 1), (2, 1, 2, 31, 2), (3, 2, 1, 32, 1)])
    edges = make(EDGES, [(2, 3, 0)])
    states = make(STATES, [(40, 1, "I"), (41, 2, "I"), (40, 3, "I")])
    got = flat.flat_frame(person, edges, states, TRAIN).select(*OUT)
    assert rows_of(got) == [(1, 0, 0, 0, 0, 1), (2, 1, 1, 1, 1, 1), (3, 1, 0, 1, 1, 0)]


def test_flags_follow_the_order_of_onsets(make):
    days = make("pid1 long, pid2 long, lid long, day_p1 long, day_p2 long",
                [(1, 2, 0, 10, 9), (1, 2, 0, 10, 7), (1, 2, 0, 10, 10), (1, 2, 0, 10, -1), (1, 2, 0, 8, 10)])
    got = [(r["infect_p2"], r["infect_p1"]) for r in flat.transmission_flags(days, 2).collect()]
    assert got == [(1, 0), (0, 0), (0, 0), (0, 0), (0, 1)]


def test_swapping_ends_changes_nothing(make):
    _, edges, states = _world(make, 3)
    swapped = edges.selectExpr("pid2 AS pid1", "pid1 AS pid2", "lid")
    affected = flat.affected_cohort(states, TRAIN)

    def counts(e):
        return rows_of(flat.contact_counts(flat.transmission_flags(flat.edge_days(e, affected), 2)))

    assert counts(edges) == counts(swapped)


def test_clients_see_only_their_rows(make):
    person, edges, states = _world(make, 4)
    alone = flat.flat_frame(person, edges, states, TRAIN).select(*OUT)
    together = None
    from pyspark.sql import functions as F

    tagged = []
    for table in (person, edges, states):
        a, b = table.withColumn("client_id", F.lit(1)), table.withColumn("client_id", F.lit(2))
        tagged.append(a.unionByName(b))
    together = flat.flat_frame(*tagged, TRAIN, ("client_id",))
    for client in (1, 2):
        assert rows_of(together.where(F.col("client_id") == client).select(*OUT)) == rows_of(alone)


def test_developer_labels(make):
    states = make(STATES, [(49, 1, "I"), (50, 1, "S"), (50, 2, "I"), (51, 2, "I"), (54, 2, "R")])
    assert rows_of(flat.true_labels(states)) == [(1, 0, 0), (2, 2, 1)]
    person = make(PERSON, [(1, 1, 1, 30, 1), (2, 1, 2, 31, 2)])
    assert rows_of(flat.status_on_day(person, states, 51)) == [(1, 30, 1, 0), (2, 31, 2, 1)]


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_contacts_of_clients_are_read_once(spark):
    tables = fixtures.client_tables(spark, "/root/testdata/sf0.001")
    frame = flat.flat_frame(tables["person"], tables["population_network"], tables["disease_outcome_training"],
                            RunParams(window=2, end_day=49, fixed_ending=49), ("client_id",), Workspace(spark, "once"))
    plan = _final_plan(frame)
    assert plan.count("explode(array(struct(pid") == 1 and "ReusedExchange" in plan


def test_contacts_are_dealt_over_a_number_that_is_kept(spark):
    edges = tables_io.network_edges(fixtures.network(spark, "/root/testdata/sf0.001"))
    assert edges.rdd.getNumPartitions() >= 200


def _lookups(plan):
    """What stands on the right of the anti joins of a plan."""
    below = [plan.children().apply(i) for i in range(plan.children().length())]
    own = [below[1].nodeName()] if plan.nodeName() == "Join" and plan.joinType().toString() == "LeftAnti" else []
    return own + [name for child in below for name in _lookups(child)]


def test_people_ever_ill_are_one_row_each_in_the_broadcast(make, spark):
    people = make("pid long, hid long, age long, sex long", [(p, 1, 1, 1) for p in (1, 2, 3)])
    states = make("day long, pid long, state string", [(d, 1, "R") for d in range(50)])
    network = make("pid1 long, pid2 long, lid long", [(1, 2, 1), (2, 3, 1)])
    frame = flat.uninfected_features(people, network, states, RunParams(window=2, end_day=49, fixed_ending=49))
    got = sorted(r["pid"] for r in frame.collect())
    assert got == [2, 3]
    assert _lookups(frame._jdf.queryExecution().optimizedPlan()) == ["Aggregate"]


def test_stepwise_frame_is_the_same_and_reads_stored_places(make, spark):
    person, edges, states = _world(make, 5)
    edges = edges.unionByName(make(EDGES, [(1, 2, None), (None, 3, 1), (4, None, 2), (1, 2, None), (5, 5, 3)]))
    person = person.unionByName(make(PERSON, [(7, 2, 1, None, 1), (7, 2, 1, None, 1), (50, None, 1, 20, 2)]))
    for params in (TRAIN, TEST):
        plain = rows_of(flat.flat_frame(person, edges, states, params))
        frame = flat.flat_frame(person, edges, states, params, (), Workspace(spark, "steps"), stepwise=True)
        plan = _final_plan(frame)
        assert rows_of(frame) == plain
        assert "explode(array(struct(pid" not in plan and "place-people" in plan and "place-sums" in plan
