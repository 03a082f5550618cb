import hashlib
import math
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from contagia.catalog.queries import QUERIES
from contagia.functions.scaling import z_name
from contagia.params import FederatedParams, RunParams
from contagia.plans import federated as fed
from contagia.sources import fixtures
from contagia.sources import tables as io
from contagia.sources.workspace import Workspace, checkpoint_root
from rows import rows_of

COLUMNS = ["a", "b"]
QUIET = FederatedParams(noise=False)


def _rows(make, sizes, seed=1):
    rng = np.random.default_rng(seed)
    rows, pid = [], 0
    for client, n in sizes.items():
        for _ in range(n):
            a, b = rng.normal(size=2)
            rows.append((client, pid, int(rng.random() < 1 / (1 + math.exp(-a))), float(a), float(b)))
            pid += 1
    return make(f"client_id long, pid long, covid long, {z_name('a')} double, {z_name('b')} double", rows), rows


def _order(pid):
    return ((pid % 1000003) * 2654435761) % 1000003, pid


def _gradient(rows, w, batch, mode):
    """Batch by batch, as an epoch runs."""
    rows = sorted(rows, key=lambda r: _order(r[1]))
    total = np.zeros(3)
    for i in range(0, len(rows), batch):
        part = rows[i:i + batch]
        x = np.array([[r[3], r[4], 1.0] for r in part])
        y = np.array([r[2] for r in part])
        p = 1 / (1 + np.exp(-x @ w))
        error = p - y if mode == "textbook" else (1 / (1 + np.exp(-p)) - y) * p * (1 - p)
        total += x.T @ error / len(part)
    return total


@pytest.mark.parametrize("mode", ["textbook", "parity"])
def test_epochs_match_a_batch_loop(spark, make, mode):
    df, rows = _rows(make, {1: 300, 2: 128, 3: 5})
    config = replace(QUIET, mode=mode, epochs=3, learning_rate=0.5, mu=0.1, max_grad_norm=1.5)
    model = fed.train(df, config, Workspace(spark, "test"), COLUMNS)
    shared, n = np.zeros(3), 0
    for client in (1, 2, 3):
        mine = [r for r in rows if r[0] == client]
        w = np.zeros(3)
        for _ in range(config.epochs):
            g = _gradient(mine, w, 128, mode)
            if mode == "textbook":
                g = g + 0.1 * math.ceil(len(mine) / 128) * w
                g = g * min(1, 1.5 / np.linalg.norm(g))
            w = w - 0.5 * g
        shared, n = shared + len(mine) * w, n + len(mine)
    assert list(model.weights) == pytest.approx(list(shared / n), abs=1e-9)
    assert model.rounds.count() == 3


def test_one_client_average_is_the_client(make):
    params = make("client_id long, idx long, value double, n long", [(1, 0, 0.5, 9), (1, 1, -2.0, 9)])
    assert rows_of(fed.fed_avg(params)) == [(0, 0.5), (1, -2.0)]


def test_rounds_start_from_the_average(spark, make):
    df, _ = _rows(make, {1: 60, 2: 30})
    model = fed.train(df, replace(QUIET, rounds=2, epochs=1, learning_rate=0.5), Workspace(spark, "t"), COLUMNS)
    assert sorted({r["round"] for r in model.rounds.collect()}) == [0, 1]
    first = [r["value"] for r in model.rounds.where("round = 0").orderBy("idx").collect()]
    assert first != pytest.approx(list(model.weights))


def test_batches_end_with_the_remainder(make):
    df, _ = _rows(make, {1: 300, 2: 256, 3: 5})
    got = fed.batch_weights(df, 128).groupBy("client_id").agg(
        F.sum("row_weight").alias("s"), F.max("last_batch").alias("l"), F.max("batches").alias("b")
    )
    assert [(c, round(s, 9), last, b) for c, s, last, b in rows_of(got)] == [
        (1, 3.0, 44, 3), (2, 2.0, 128, 2), (3, 1.0, 5, 1)]


def test_noise_has_the_stated_scale_and_repeats(make):
    params = make("client_id long, idx long, value double, n long",
                  [(c, i, 0.0, 1) for c in range(4000) for i in range(5)])
    sigma = fed.noise_scale(F.lit(128), 3.0)
    draw = fed.gaussian_noise(params, sigma, seed=5)
    values = np.array([r["value"] for r in draw.collect()])
    scale = math.sqrt(2 * math.log(1.25 * 128)) / 3
    assert abs(values.mean()) < 4 * scale / math.sqrt(len(values))
    assert values.std() == pytest.approx(scale, rel=0.03)
    assert np.mean(np.abs(values) < scale) == pytest.approx(0.6827, abs=0.015)
    assert rows_of(draw) == rows_of(fed.gaussian_noise(params.repartition(7), sigma, seed=5))
    assert rows_of(draw) != rows_of(fed.gaussian_noise(params, sigma, seed=6))
    assert rows_of(draw) != rows_of(fed.gaussian_noise(params, sigma, seed=5, step=1))


def test_clipping_only_shortens(make):
    g = make("client_id long, idx long, gradient double", [(1, 0, 3.0), (1, 1, 4.0), (2, 0, 0.3), (2, 1, 0.4)])
    got = {(r["client_id"], r["idx"]): r["gradient"] for r in fed.clip_gradient(g, 1.0).collect()}
    assert got == pytest.approx({(1, 0): 0.6, (1, 1): 0.8, (2, 0): 0.3, (2, 1): 0.4})


def test_training_and_scoring_through_storage(spark, tmp_path):
    tables = fixtures.client_tables(spark, "/root/testdata/sf0.001")
    paths = {k: str(tmp_path / k) for k in ("train", "test", "rounds", "out", "out2")}
    model, quality = fed.fit_clients(spark, tables, paths["train"], paths["rounds"], QUIET)
    assert quality.count() == 5
    assert fed.load_weights(spark, paths["rounds"]) == model.weights
    scored = fed.predict_clients(spark, tables, paths["test"], paths["rounds"], paths["out"])
    assert scored.count() == 150
    written = spark.read.option("header", True).csv(paths["out"])
    assert sorted(written.columns) == ["client_id", "pid", "score"] and written.count() == 150
    own = fed.predict_clients(spark, tables, paths["test"], paths["rounds"], paths["out2"], own_scaling=True)
    assert own.count() == 150 and rows_of(own) != rows_of(scored)


def test_prepared_features_of_other_parameters_are_not_taken(spark, tmp_path):
    tables, path = fixtures.client_tables(spark, "/root/testdata/sf0.001"), str(tmp_path / "f")
    first = fed.prepared_frame(spark, tables, RunParams(window=2, end_day=49, fixed_ending=49), path)
    other = fed.prepared_frame(spark, tables, RunParams(window=7, end_day=30, fixed_ending=30, is_training=False), path)
    assert rows_of(first) != rows_of(other)


def test_changed_inputs_are_prepared_anew(spark, tmp_path):
    tables, path = fixtures.client_tables(spark, "/root/testdata/sf0.001"), str(tmp_path / "f")
    params = RunParams(window=2, end_day=49, fixed_ending=49)
    first = fed.prepared_frame(spark, tables, params, path)
    shuffled = {k: t.select(*reversed(t.columns)).repartition(3) for k, t in tables.items()}
    assert io.fingerprint(tables, fed.INPUTS) == io.fingerprint(shuffled, fed.INPUTS)
    fed.prepared_frame(spark, shuffled, params, path)
    folders = lambda: len(list((tmp_path / "f").iterdir()))
    assert folders() == 1
    changed = tables | {"person": tables["person"].withColumn("age", F.when(F.col("pid") == 1, 99).otherwise(F.col("age")).cast("long"))}
    second = fed.prepared_frame(spark, changed, params, path)
    assert folders() == 2 and rows_of(first) != rows_of(second)
    twice = tables | {"person": tables["person"].unionByName(tables["person"].limit(1))}
    assert io.fingerprint(twice, fed.INPUTS) != io.fingerprint(tables, fed.INPUTS)


def _drawn(seed, step, client, idx):
    u, v = ((int(hashlib.md5(f"{seed}:{step}:{client}:{idx}:{part}".encode()).hexdigest()[:13], 16) + 1) / 2**52 for part in ("radius", "angle"))
    return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)


def test_default_training_with_noise_from_a_seed(spark, make):
    df, rows = _rows(make, {1: 300, 2: 128, 3: 5})
    config = FederatedParams(seed=11)
    assert config.noise and config.epochs == 5
    model = fed.train(df, config, Workspace(spark, "test"), COLUMNS)
    shared, n = np.zeros(3), 0
    for client in (1, 2, 3):
        mine, w = [r for r in rows if r[0] == client], np.zeros(3)
        batches = math.ceil(len(mine) / 128)
        sigma = math.sqrt(2 * math.log(1.25 * (len(mine) - 128 * (batches - 1)))) / 3
        for step in range(5):
            g = _gradient(mine, w, 128, "textbook") + 0.01 * batches * w
            g = g * min(1, 10 / np.linalg.norm(g))
            w = w - 0.001 * g + sigma * np.array([_drawn(11, step, client, i) for i in range(3)])
        shared, n = shared + len(mine) * w, n + len(mine)
    assert list(model.weights) == pytest.approx(list(shared / n), abs=1e-9)


def test_privacy_adds_up(make):
    df, _ = _rows(make, {1: 300, 2: 128, 3: 1})
    rows = fed.batch_weights(df, 128)
    spent = {(r["round"], r["client_id"]): r for r in fed.privacy_spent(rows, FederatedParams(epochs=2, rounds=2, epsilon=0.5)).collect()}
    assert len(spent) == 6 and [spent[r, 1]["steps"] for r in (0, 1)] == [2, 4]
    for (number, client), last in {(0, 1): 44, (1, 1): 44, (1, 2): 128, (1, 3): 1}.items():
        got, steps = spent[number, client], 2 * (number + 1)
        rho = steps * 0.25 / (4 * math.log(1.25 * last))
        assert got["epsilon"] == pytest.approx(0.5 * steps) and got["delta"] == pytest.approx(min(1, steps / last))
        assert got["tight_epsilon"] == pytest.approx(rho + 2 * math.sqrt(rho * math.log(last)))
    assert fed.privacy_spent(rows, QUIET).count() == 0


def test_a_secret_seed_is_drawn_for_each_run(spark, make):
    assert FederatedParams().seed is None and fed.with_secret_seed(FederatedParams(seed=3)).seed == 3
    df, _ = _rows(make, {1: 60, 2: 30})
    config = FederatedParams(epochs=1)
    one, two = (fed.train(df, config, Workspace(spark, "seed"), COLUMNS).weights for _ in range(2))
    assert one != two
    with pytest.raises(ValueError):
        fed.gaussian_noise(make("client_id long, idx long, value double", [(1, 0, 0.0)]), F.lit(1.0), None)


def test_steps_of_prepared_features_are_deleted(spark, tmp_path):
    tables, root = fixtures.client_tables(spark, "/root/testdata/sf0.001"), Path(checkpoint_root(spark).removeprefix("file://"))
    steps = lambda: {p.name for p in root.glob("client-status-*")}
    before = steps()
    frame = fed.prepared_frame(spark, tables, RunParams(window=2, end_day=49, fixed_ending=49), str(tmp_path / "f"))
    assert steps() == before and frame.count() == 150


class _Given(Exception):
    pass


@pytest.mark.parametrize("name", ["k10_outcome_precision", "k10_client_predictions", "k10_predictions_own_scaling"])
def test_contacts_of_clients_are_joined_once_for_fit_and_predict(spark, monkeypatch, name):
    def fit(spark, tables, *_):
        raise _Given(tables)

    monkeypatch.setattr(fed, "fit_clients", fit)
    with pytest.raises(_Given) as given:
        QUERIES[name](spark, "/root/testdata/sf0.001")
    network = given.value.args[0]["population_network"]
    assert network.count() == fixtures.network(spark, "/root/testdata/sf0.001", True).count()
    assert all("/network/" in f for f in network.inputFiles())
