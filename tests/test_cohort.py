from pyspark.sql import functions as F

from contagia.operators import cohort, labels
from contagia.params import RunParams
from rows import rows_of

P = RunParams(window=2, end_day=49, fixed_ending=49)
STATES = "day long, pid long, state string"


def _states(make, days):
    rows = [(day, pid, s) for pid, text in days.items() for day, s in enumerate(text)]
    return make(STATES, rows)


def test_recovery_before_illness_gives_two_intervals(make):
    # pid 1: recovered on day 1, ill from day 3, recovered again on day 60 (after the ending)
    rows = [(0, 1, "S"), (1, 1, "R"), (3, 1, "I"), (4, 1, "I"), (60, 1, "R")]
    timeline = cohort.infection_timeline(make(STATES, rows))
    assert rows_of(timeline) == [(1, 3, 4, 1, 60)]
    assert cohort.recovered_timeline(timeline, P).count() == 0
    silent = cohort.asymptomatic_timeline(timeline, P)
    assert rows_of(silent) == [(1, 1)]
    merged = cohort.merge_cohorts(timeline, cohort.backdate(silent), P)
    assert rows_of(merged) == [(1, -1, 1, 0), (1, 3, 4, 1)]
    assert rows_of(cohort.constant_cohort(timeline, P)) == rows_of(merged)


def test_first_recovery_not_before_illness_is_taken(make):
    rows = [(1, 1, "R"), (3, 1, "I"), (5, 1, "R"), (6, 1, "R")]
    timeline = cohort.infection_timeline(make(STATES, rows))
    assert rows_of(cohort.recovered_timeline(timeline, P)) == [(1, 5, 3)]
    assert cohort.asymptomatic_timeline(timeline, P).count() == 0


def test_last_day_is_not_cut_at_the_fixed_ending(make):
    rows = [(48, 1, "I"), (55, 1, "I"), (50, 2, "I")]
    timeline = cohort.infection_timeline(make(STATES, rows))
    assert rows_of(cohort.constant_cohort(timeline, P)) == [(1, 48, 55, 1)]


def test_predicted_patients_only_join_when_unknown(make):
    timeline = cohort.infection_timeline(_states(make, {1: "SIIR", 2: "SSSS"}))
    extra = make("pid long, first_day long", [(1, 49), (2, 49), (2, 49)])
    got = cohort.study_cohort(timeline, P, extra)
    assert rows_of(got) == [(1, 1, 2, 1), (2, 49, 54, 2)]


def test_household_size_counts_patients_only(make):
    person = make("pid long, hid long, person_number long, age long, sex long",
                  [(1, 7, 1, 30, 1), (2, 7, 2, 40, 2), (3, 7, 9, 50, 1), (4, 8, 3, 20, 2)])
    silent = make("pid long, last_day long", [(1, 10), (2, 11), (4, 12)])
    got = cohort.recovery_features(person, silent).select("pid", "total_family_members", "last_day")
    assert rows_of(got) == [(1, 2, 10), (2, 2, 11), (4, 3, 12)]


def test_cohort_and_susceptible_are_disjoint(make):
    person = make("pid long", [(1,), (2,), (3,)])
    intervals = make("pid long, first_day long, last_day long", [(1, 5, 9), (1, 20, 22)])
    assert rows_of(cohort.susceptible(person, intervals, P)) == [(2, 44, 42), (3, 44, 42)]
    assert rows_of(cohort.susceptible(person, intervals, P, True)) == [(2, 49, 47), (3, 49, 47)]


def test_labels(make):
    timeline = cohort.infection_timeline(_states(make, {1: "SIIR", 2: "S" * 56 + "I", 3: "S" * 60, 4: "S" * 56 + "R"}))
    p = RunParams(window=2, end_day=56, fixed_ending=55)
    intervals = cohort.infection_intervals(cohort.study_cohort(timeline, p))
    person = make("pid long", [(1,), (2,), (3,), (4,)])
    people = cohort.susceptible(person, intervals, p)
    current = labels.positives_on_day(timeline, 56)
    assert rows_of(current) == [(2, 1), (4, 1)]
    assert rows_of(labels.training_labels(intervals, people, p)) == [(1, 1), (2, 0), (3, 0), (4, 0)]
    assert rows_of(labels.testing_labels(intervals, people, current)) == [(2, 1), (3, 0), (4, 1)]
    assert rows_of(labels.inference_set(people, current)) == [(3, 0)]


def test_states_are_never_broadcast_for_later_recoveries(spark, tmp_path):
    # an explode makes the states 50 times what the planner takes them for, and the file is compressed
    path = str(tmp_path / "people")
    spark.range(20000).withColumnRenamed("id", "pid").coalesce(1).write.option("compression", "zstd").parquet(path)
    people = spark.read.schema("pid long").parquet(path)
    day = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long")))
    state = F.when(F.col("day") == 20, "I").when(F.col("day") % 10 == 5, "R").otherwise("S")
    states = people.withColumn("day", day).withColumn("state", state)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "200000")
    try:
        timeline = cohort.infection_timeline(states)
        got = timeline.collect()
        plan = timeline._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    assert {tuple(r)[1:] for r in got} == {(20, 20, 5, 25)} and len(got) == 20000
    assert "BuildLeft" not in plan


def test_later_recovery_skips_days_before_the_illness_and_people_without_id(make):
    rows = [(1, 1, "R"), (3, 1, "I"), (2, 1, "R"), (4, 2, "R"), (9, 2, "I"), (1, None, "R"), (2, None, "I"), (5, None, "R")]
    timeline = cohort.infection_timeline(make(STATES, rows))
    assert rows_of(timeline) == [(1, 3, 3, 1, None), (2, 9, 9, 4, None), (None, 2, 2, 1, None)]
