"""Exposure operators against row-by-row brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from contagia.operators import exposure, lags
from rows import rows_of

INTERVALS = "pid long, first_day long, last_day long"
VISITS = "pid long, lid long, start_time long, duration long"


def _touching(first, last, end, w):
    return (max(first, end - w), min(last, end)) if first <= end and last >= end - w else None


def _brute(visits, intervals, windows, w):
    """All pairs: {(pid, window_end, lo, hi): [meetings, minutes]}"""
    out = {}
    for pid, end in windows:
        for p, lid, _, _ in visits:
            if p != pid:
                continue
            for q, place, _, minutes in visits:
                if place != lid or q == pid:
                    continue
                for r, first, last in intervals:
                    bounds = _touching(first, last, end, w) if r == q else None
                    if bounds:
                        cell = out.setdefault((pid, end, *bounds), [0, 0])
                        cell[0] += 1
                        cell[1] += minutes
    return sorted((*k, *v) for k, v in out.items())


@pytest.mark.parametrize("seed,w", [(1, 1), (2, 2), (3, 5), (4, 9), (5, 20)])
def test_place_exposure_equals_all_pairs(make, seed, w):
    rng = random.Random(seed)
    visits = [(rng.randrange(25), rng.choice([0, 0, 0, 1, 2, 3]), 0, rng.randrange(1, 90)) for _ in range(160)]
    intervals = set()
    for pid in range(16):
        for _ in range(rng.choice([1, 1, 2])):
            first = rng.randrange(-3, 40)
            intervals.add((pid, first, first + rng.randrange(-2, 14)))
    intervals = sorted(intervals)
    ill = {p for p, _, _ in intervals}
    end = 30
    v, i = make(VISITS, visits), make(INTERVALS, intervals)
    links = exposure.place_links(v)
    people = make("pid long, last_day long, first_day long",
                  [(p, end, end - w) for p in range(25) if p not in ill])

    own = exposure.place_exposure(exposure.shared_terms(links, i, exposure.infected_windows(i, w), w))
    windows = [(p, first) for p, first, _ in intervals]
    expected_own = _brute(visits, intervals, windows, w)
    assert rows_of(own) == expected_own

    fixed = exposure.place_exposure(exposure.fixed_terms(links, i, people, w, end))
    expected_fixed = _brute(visits, intervals, [(p, end) for p in range(25) if p not in ill], w)
    assert rows_of(fixed) == expected_fixed

    both = exposure.infected_windows(i, w).unionByName(exposure.fixed_windows(people))
    together = exposure.place_exposure(exposure.shared_terms(links, i, both, w))
    assert rows_of(together) == sorted(expected_own + expected_fixed)


def test_intervals_touching_on_one_day(make):
    person = make("pid long, hid long", [(1, 5), (2, 5), (3, 5)])
    intervals = make(INTERVALS, [(1, 10, 12), (2, 5, 8), (3, 10, 10)])
    links = exposure.household_links(person)
    got = exposure.household_exposure(
        exposure.shared_terms(links, intervals, exposure.infected_windows(intervals, 2), 2)
    )
    # 1 and 3 meet on day 10; 2 was last ill on day 8, the first day of their windows
    assert rows_of(got) == [(1, 10, 8, 8, 1), (1, 10, 10, 10, 1), (3, 10, 8, 8, 1), (3, 10, 10, 10, 1)]


def test_repeated_visits_multiply(make):
    visits = make(VISITS, [(1, 9, 0, 10), (1, 9, 1, 20), (2, 9, 0, 30), (2, 9, 1, 40), (2, 9, 2, 50)])
    intervals = make(INTERVALS, [(1, 10, 12), (2, 10, 12)])
    links = exposure.place_links(visits)
    got = exposure.place_exposure(
        exposure.shared_terms(links, intervals, exposure.infected_windows(intervals, 2), 2)
    )
    assert rows_of(got) == [(1, 10, 10, 10, 6, 240), (2, 10, 10, 10, 6, 90)]


def test_equal_rows_of_both_sides_count_once(make):
    # 5 met 1 (stored as 5, 1's side first) and 9 (stored second): the same bounds, the same sum
    network = make("pid1 long, pid2 long, lid long", [(1, 5, 0), (5, 9, 0), (2, 6, 0), (6, 9, 0), (6, 9, 1)])
    intervals = make(INTERVALS, [(1, 10, 12), (9, 10, 12), (2, 10, 12), (5, 11, 13), (6, 11, 13)])
    contacts = exposure.contact_table(network, intervals)
    got = exposure.contact_exposure(contacts, 2).where(F.col("pid").isin(5, 6))
    # person 5: 1 + 1 collapses to 1; person 6: 1 + 2 adds up to 3
    assert rows_of(got) == [(5, 11, 10, 11, 1), (6, 11, 10, 11, 3)]


def test_contact_counts_with_two_intervals(make):
    network = make("pid1 long, pid2 long, lid long", [(1, 2, 0), (1, 2, 1), (3, 4, 0)])
    intervals = make(INTERVALS, [(1, 3, 4), (1, 10, 12)])
    got = exposure.contact_table(network, intervals)
    assert rows_of(got) == [(1, 2, 3, 4, None, None, 2), (1, 2, 10, 12, None, None, 2),
                            (3, 4, None, None, None, None, 1)]
    well = exposure.contact_exposure(got, 2, fixed_end=11)
    assert rows_of(well) == [(2, 11, 10, 11, 2)]


def test_contacts_of_everybody_are_both_kinds_together(make):
    rng = random.Random(7)
    pairs = [tuple(sorted(rng.sample(range(30), 2))) + (0,) for _ in range(300)]
    intervals = [(p, rng.randrange(30), 0) for p in range(18)]
    intervals = [(p, f, f + rng.randrange(10)) for p, f, _ in intervals]
    contacts = exposure.contact_table(make("pid1 long, pid2 long, lid long", pairs), make(INTERVALS, intervals))
    from contagia.params import RunParams

    p = RunParams(window=3, end_day=25, fixed_ending=40)
    together = rows_of(exposure.all_contact_exposure(contacts, p))
    assert together == sorted(
        rows_of(exposure.contact_exposure(contacts, 3)) + rows_of(exposure.contact_exposure(contacts, 3, 20))
    )
    # brute force for infected subjects
    first = {q: (f, last) for q, f, last in intervals}
    sides = [Counter(), Counter()]
    for a, b, _ in pairs:
        for side, (me, you) in enumerate(((a, b), (b, a))):
            if me in first and you in first:
                bounds = _touching(*first[you], first[me][0], 3)
                if bounds:
                    sides[side][(me, first[me][0], *bounds)] += 1
    expected = Counter()
    for key, n in set(sides[0].items()) | set(sides[1].items()):
        expected[key] += n
    assert rows_of(exposure.contact_exposure(contacts, 3)) == sorted((*k, n) for k, n in expected.items())


def test_lags_and_overlap(make):
    rows = [(1, 10, 9, 10, 4), (1, 10, 8, 8, 2), (2, 10, 8, 10, 1)]
    table = make("pid long, window_end long, max_end long, min_end long, total_interactions long", rows)
    got = lags.lag_pivot(table, "total_interactions", "x", 3)
    assert got.columns == ["pid", "x_lag_day_0", "x_lag_day_1", "x_lag_day_2"]
    assert rows_of(got) == [(1, 4, 4, 2), (2, 1, 1, 1)]
    one = lags.lag_pivot(table, "total_interactions", "x", 1)
    assert rows_of(one) == [(1, 4), (2, 1)]
    assert sorted(r["overlap"] for r in exposure.with_overlap(table).collect()) == [1, 2, 3]


def test_place_totals_weigh_repeated_visits(make):
    visits = make(VISITS, [(1, 9, 0, 30), (1, 9, 1, 30), (2, 9, 0, 60), (2, 8, 0, 90)])
    got = rows_of(exposure.place_totals(visits))
    assert got == [(1, 6, 4.0), (2, 4, 3.5)]
