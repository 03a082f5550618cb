import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from contagia.functions import metrics, prefix, ranking, scaling
from contagia.functions.logistic import fit_logistic, moments
from rows import rows_of


def _average_precision(pairs):
    """Step-wise definition, one threshold at a time."""
    total = sum(y for y, _ in pairs)
    if not total:
        return 0.0
    out, before = 0.0, 0.0
    for t in sorted({s for _, s in pairs}, reverse=True):
        seen = [y for y, s in pairs if s >= t]
        recall = sum(seen) / total
        out += (recall - before) * sum(seen) / len(seen)
        before = recall
    return out


@pytest.mark.parametrize("rows_per_range", [3, 20, 500_000])
def test_average_precision_with_ties(make, rows_per_range):
    rng = random.Random(3)
    rows = [(g, rng.randrange(2), round(rng.random() ** 3, 2)) for g in (1, 2) for _ in range(400)]
    df = make("g long, y long, s double", rows)
    got = metrics.average_precision(df, "y", "s", rows_per_range=rows_per_range).first()[0]
    assert got == pytest.approx(_average_precision([(y, s) for _, y, s in rows]), abs=1e-12)
    per = dict(rows_of(metrics.average_precision(df, "y", "s", ["g"], rows_per_range=rows_per_range)))
    for g in (1, 2):
        assert per[g] == pytest.approx(_average_precision([(y, s) for h, y, s in rows if h == g]), abs=1e-12)


def test_average_precision_without_positives(make):
    df = make("y long, s double", [(0, 0.1), (0, 0.5)])
    assert metrics.average_precision(df, "y", "s").first()[0] == 0.0


def test_threshold_metrics_and_losses(make):
    df = make("y long, s double", [(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.1), (1, 1.0), (0, 0.0)])
    assert tuple(metrics.precision_recall(df, "y", "s").first()) == (pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert tuple(metrics.precision_recall(df, "y", "s", 2.0).first()) == (0.0, 0.0)
    assert metrics.accuracy(df, "y", "s").first()[0] == pytest.approx(100 * 4 / 6)
    assert metrics.accuracy(df, "y", "s", single_column_argmax=True).first()[0] == pytest.approx(50)
    clip = [min(max(p, 1e-15), 1 - 1e-15) for p in (0.9, 0.4, 0.6, 0.1, 1.0, 0.0)]
    losses = [-math.log(p if y else 1 - p) for y, p in zip((1, 1, 0, 0, 1, 0), clip)]
    assert metrics.log_loss(df, "y", "s").first()[0] == pytest.approx(np.mean(losses))
    assert metrics.bce_with_logits(df, "y", "s").first()[0] == pytest.approx(np.mean(losses))
    sig = [1 / (1 + math.exp(-p)) for p in (0.9, 0.4, 0.6, 0.1, 1.0, 0.0)]
    double = [-math.log(q if y else 1 - q) for y, q in zip((1, 1, 0, 0, 1, 0), sig)]
    assert metrics.bce_with_logits(df, "y", "s", second_sigmoid=True).first()[0] == pytest.approx(np.mean(double))
    table = make("n long, accuracy double", [(1, 10.0), (3, 50.0)])
    assert metrics.weighted_average(table, "accuracy").first()[0] == pytest.approx(40)


def _order(pid):
    return ((pid % 1000003) * 2654435761) % 1000003, pid


def test_positions_follow_the_hash_order(make):
    rng = random.Random(5)
    pids = rng.sample(range(10**12), 3000)
    df = make("g long, pid long", [(p % 2, p) for p in pids])
    got = {r["pid"]: (r["_position"], r["_group_size"]) for r in ranking.with_position(df, ["g"]).collect()}
    for g in (0, 1):
        ordered = sorted((p for p in pids if p % 2 == g), key=_order)
        assert [got[p] for p in ordered] == [(i + 1, len(ordered)) for i in range(len(ordered))]


def test_split_has_the_exact_share_per_label(make):
    rows = [(p, int(p % 7 == 0)) for p in range(500)]
    got = ranking.stratified_split(make("pid long, y long", rows), "y").collect()
    test = Counter(r["y"] for r in got if r["is_test"])
    sizes = Counter(y for _, y in rows)
    assert test == {y: math.ceil(0.1 * n) for y, n in sizes.items()}


@pytest.mark.parametrize("n,parts", [(10, 3), (7, 7), (5, 8), (100, 9)])
def test_parts_differ_by_one_at_most(make, n, parts):
    got = ranking.equal_parts(make("pid long", [(p,) for p in range(n)]), parts).collect()
    sizes = Counter(r["part"] for r in got)
    expected = [len(x) for x in np.array_split(np.arange(n), parts)]
    assert [sizes.get(i + 1, 0) for i in range(parts)] == expected
    by_part = [r["part"] for r in sorted(got, key=lambda r: _order(r["pid"]))]
    assert by_part == sorted(by_part)


def test_scaling_fills_nulls_and_keeps_constants(make):
    df = make("pid long, a long, b double", [(1, None, 5.0), (2, 4, 5.0), (3, 8, 5.0)])
    scaler = scaling.fit_scaler(df, ["a", "b"])
    got = [(r["z_a"], r["z_b"]) for r in scaler.apply(df).orderBy("pid").collect()]
    std = np.std([0, 4, 8])
    assert got == [(pytest.approx(-4 / std), 0.0), (0.0, 0.0), (pytest.approx(4 / std), 0.0)]
    grouped = df.withColumn("g", F.lit(1))
    stats = scaling.group_statistics(grouped, ["a", "b"], ["g"])
    again = scaling.apply_group_statistics(grouped, stats, ["a", "b"], ["g"]).orderBy("pid")
    assert [(r["z_a"], r["z_b"]) for r in again.collect()] == got


@pytest.mark.parametrize("rows_per_range", [11, 100, 500_000])
def test_running_sums(make, rows_per_range):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None, 3]), i, rng.choice([1, 5, None]), rng.random()) for i in range(400)]
    rng.shuffle(rows)
    frame = make("g long, k long, v long, w double", rows).repartition(3)
    for groups in ([], ["g"]):
        got = prefix.running_sums(frame, groups, [F.desc("k")], ["v", "w"], rows_per_range)
        assert set(got.columns) == {"g", "k", "v", "w", "running_v", "running_w", "total_v", "total_w"}
        for r in got.collect():
            own = [x for x in rows if not groups or x[0] == r.g]
            above = [x for x in own if x[1] >= r.k]
            assert r.running_v == sum(x[2] or 0 for x in above) and r.total_v == sum(x[2] or 0 for x in own)
            assert r.running_w == pytest.approx(sum(x[3] for x in above)) and r.total_w == pytest.approx(sum(x[3] for x in own))
    assert prefix.running_sums(frame.limit(0), ["g"], [F.desc("k")], ["v"]).count() == 0


def test_ranges_follow_the_rows():
    assert [prefix.number_of_ranges(n, 200) for n in (0, 1, 50_000, 10**6, 10**9, 10**12)] == [1, 1, 5, 100, 2000, 2_000_000]


def test_logistic_newton(make):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 3)) * [1, 30, 0.01]
    y = (rng.random(500) < 1 / (1 + np.exp(-(x[:, 0] * 2 - 1)))).astype(int)
    rows = [(*map(float, x[i]), int(y[i])) for i in range(500)]
    frame = make("a double, b double, c double, y long", [*rows, (1.0, 1.0, 1.0, None)]).repartition(7)
    found = fit_logistic(frame, ["a", "b", "c"], "y", penalty=2.0)
    full, beta, ridge = np.c_[np.ones(500), x], np.zeros(4), np.diag([0.0, 2, 2, 2])
    for _ in range(60):
        p = 1 / (1 + np.exp(-full @ beta))
        beta -= np.linalg.solve(full.T * (p * (1 - p)) @ full + ridge, full.T @ (p - y) + ridge @ beta)
    assert found.converged and [found.intercept, *found.weights] == pytest.approx(list(beta), abs=1e-8)
    loss, slope, curve = moments(frame, ["a", "b", "c"], "y", beta)
    assert slope + ridge @ beta == pytest.approx(np.zeros(4), abs=1e-6) and curve.shape == (4, 4)
    assert loss + beta @ ridge @ beta / 2 == pytest.approx(found.loss)


def test_logistic_without_rows_one_class_and_separated(make):
    empty = fit_logistic(make("a double, y long", []), ["a"], "y")
    assert (empty.intercept, empty.weights, empty.loss) == (0.0, (0.0,), 0.0)
    ones = fit_logistic(make("a double, y long", [(1.0, 1), (2.0, 1)]), ["a"], "y")
    assert ones.intercept > 5 and np.isfinite(ones.loss)
    apart = fit_logistic(make("a double, b double, y long", [(float(i), 1.0, int(i > 5)) for i in range(10)]), ["a", "b"], "y", penalty=1e-6)
    assert apart.weights[0] > 5 and np.isfinite(apart.intercept)
