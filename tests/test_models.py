import random
from collections import defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml import PipelineModel

from contagia.params import RunParams
from contagia.plans import api, daily, master, modelling
from contagia.sources import fixtures
from contagia.sources import tables as io
from contagia.sources.workspace import Workspace
from rows import rows_of

SF = "/root/testdata/sf0.001"


def _recovery(make, n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for pid in range(n):
        sex, age, size = rng.randrange(1, 3), rng.randrange(90), rng.randrange(1, 6)
        days = 3 + sex + age // 30 + rng.randrange(2)
        rows.append((pid, sex, age, 1, size, days))
    schema = "pid long, sex long, age long, person_number long, total_family_members long, recovery_time long"
    return make(schema, rows), rows


def test_recovery_model_solves_the_normal_equations(spark, make):
    df, rows = _recovery(make)
    model = modelling.fit_recovery(df, Workspace(spark, "test"))
    x = np.array([r[1:3] + r[4:5] for r in rows], float)
    z = (x - x.mean(0)) / x.std(0)
    y = np.array([r[5] for r in rows], float)
    expected = np.linalg.lstsq(np.c_[np.ones(len(z)), z], y, rcond=None)[0]
    assert model.coefficients() == pytest.approx(list(expected), abs=1e-6)
    assert model.mse_train > 0 and model.mse_test > 0


def test_a_single_recovery_time_does_not_turn_the_model_off(make, spark):
    df, rows = _recovery(make, 40)
    rows = rows + [(999, 1, 30, 1, 2, 77)]
    lone = make(df.schema.simpleString()[7:-1].replace(":", " "), rows)
    model = modelling.fit_recovery(lone, Workspace(spark, "test"))
    x = np.array([r[1:3] + r[4:5] for r in rows], float)
    z = (x - x.mean(0)) / x.std(0)
    expected = np.linalg.lstsq(np.c_[np.ones(len(z)), z], np.array([r[5] for r in rows], float), rcond=None)[0]
    assert model.coefficients() == pytest.approx(list(expected), abs=1e-6)
    split = {r["pid"]: r["is_test"] for r in modelling.recovery_split(lone).collect()}
    assert len(split) == 41 and split[999] == 0 and sum(split.values()) > 0
    only = modelling.fit_recovery(lone.where("pid = 999 OR recovery_time = 4").limit(1), Workspace(spark, "test"))
    assert only.mse_test is None
    assert modelling.fit_recovery(df.limit(0), Workspace(spark, "test")) is None


def test_constant_only_without_a_complete_illness(make, spark):
    person = make("pid long, hid long, person_number long, age long, sex long", [(i, i, 1, 20 + i, 1 + i % 2) for i in range(4)])
    columns = "pid long, first_infected long, last_infected long, first_recovered long, recovered_after long"
    params = RunParams(window=2, end_day=49, fixed_ending=49)
    silent = [(3, None, None, 20, None)]
    none = modelling.backdated_asymptomatic(person, make(columns, silent), params, Workspace(spark, "test"))
    assert not none.by_model and rows_of(none.intervals) == [(3, 18, 20)]
    known = make(columns, [(0, 1, 5, 6, 6), (1, 2, 8, 9, 9), *silent])
    assert modelling.backdated_asymptomatic(person, known, params, Workspace(spark, "test")).by_model


def _newton(z, y, penalty):
    """Logistic regression with an unpenalised intercept."""
    x = np.c_[np.ones(len(z)), z]
    w, reg = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    reg[0, 0] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T * (p * (1 - p)) @ x + reg, x.T @ (p - y) + reg @ w)
    return w


def test_risk_model_matches_newton(spark, make, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 10, (400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 5) * 0.6))).astype(int)
    df = make("pid long, a long, b long, covid long", [(i, *map(int, x[i]), int(y[i])) for i in range(400)])
    model = modelling.fit_risk(df, ["a", "b"], Workspace(spark, "test"))
    z = (x - x.mean(0)) / x.std(0)
    order = defaultdict(list)
    for pid in sorted(range(400), key=lambda p: (((p % 1000003) * 2654435761) % 1000003, p)):
        order[y[pid]].append(pid)
    train = sorted(p for pids in order.values() for p in pids[int(np.ceil(0.1 * len(pids))):])
    w = _newton(z[train], y[train], 1.0)
    assert [model.intercept, *model.weights] == pytest.approx(list(w), abs=1e-8)
    assert 0.5 < model.auprc_train <= 1 and 0 < model.auprc_test <= 1

    path = str(tmp_path / "model")
    model.model.write().save(path)
    again = modelling.score_people(modelling.model_scorer(PipelineModel.load(path)), df)
    first = modelling.score_people(modelling.model_scorer(model.model), df)
    assert rows_of(again) == rows_of(first)
    expected = 1 / (1 + np.exp(-(np.c_[np.ones(400), z] @ w)))
    assert [r[2] for r in rows_of(first)] == pytest.approx(list(expected), abs=1e-8)
    quality = modelling.score_quality(first).first()
    assert 0.5 < quality["average_precision"] <= 1


def test_files_to_predictions(spark, tmp_path):
    """CSV columns in another order and with additions are read by name."""
    locations = {}
    for name, frame in fixtures.tables(spark, SF).items():
        locations[name] = str(tmp_path / name)
        shuffled = frame.select(*reversed(frame.columns)).selectExpr("'x' AS note", "*")
        shuffled.write.option("header", True).csv(locations[name])
    loaded = io.load_tables(spark, locations)
    for name, frame in fixtures.tables(spark, SF).items():
        assert rows_of(loaded[name].select(*frame.columns)) == rows_of(frame)
    fmt = str(tmp_path / "format")
    rows = [(p, 0.0) for p in (1, 2, 3, 10**9)]
    spark.createDataFrame(rows, "pid long, score double").write.option("header", True).csv(fmt)
    model_dir, out = str(tmp_path / "model"), str(tmp_path / "out")
    quality = api.fit(spark, locations, model_dir)
    assert 0 < quality.auprc_train <= 1
    got = dict(rows_of(api.predict(spark, locations, model_dir, fmt, out)))
    assert set(got) == {1, 2, 3, 10**9} and got[10**9] == 0.5
    assert all(0 <= s <= 1 for s in got.values())


def test_daily_loop_feeds_predictions_back(spark):
    tables = fixtures.tables(spark, SF)
    params = RunParams(window=2, end_day=55, fixed_ending=55, is_training=False)
    everybody = modelling.linear_scorer({"age": 0.0}, 0.0)  # 0.5 for all: everyone is predicted
    first, second = daily.forecast_days(tables, params, everybody, [55, 56], Workspace(spark, "test"))
    assert first.new_patients.count() > 0
    assert {r["first_day"] for r in first.new_patients.collect()} == {55}
    known = {r["pid"] for r in first.new_patients.collect()}
    assert not known & {r["pid"] for r in second.new_patients.collect()}
    assert not known & {r["pid"] for r in second.predictions.collect()}
    assert {"average_precision", "precision", "recall"} == set(first.quality.columns) and first.quality.count() == 1


def _rebuilt_days(spark, tables, params, scorer, days):
    """Every day built from the tables, with all patients predicted before."""
    extra, out = None, []
    for day in days:
        result = daily.forecast_day(tables, replace(params, end_day=day), scorer, extra=extra)
        workspace = Workspace(spark, "rebuilt")
        new, predictions = workspace.durable(result.new_patients, "new"), workspace.durable(result.predictions, "predictions")
        out.append((rows_of(new), rows_of(predictions), rows_of(result.quality)))
        extra = new if extra is None else extra.unionByName(new)
    return out


@pytest.mark.parametrize("days,window,look", [([52, 53, 54, 55, 56], 2, 5), ([56, 54], 3, 2)])
def test_standing_sums_equal_the_full_rebuild(spark, days, window, look):
    tables = fixtures.tables(spark, SF)
    params = RunParams(window=window, end_day=days[0], fixed_ending=51, is_training=False, look_forward=look)
    scorer = modelling.linear_scorer({"age": 0.01, "infected_interactions_lag_day_0": 0.3, "infected_interactions_loc_lag_day_0": 0.02,
                                      "family_infected_lag_day_0": 0.7}, -1.5)
    got = daily.forecast_days(tables, params, scorer, days, Workspace(spark, "test"))
    want = _rebuilt_days(spark, tables, params, scorer, days)
    assert [(rows_of(d.new_patients), rows_of(d.predictions), rows_of(d.quality)) for d in got] == want
    assert any(new for new, _, _ in want) and daily.forecast_days(tables, params, scorer, [], Workspace(spark, "test")) == []


def test_one_workspace_serves_two_builds_and_tables_have_a_format(spark, tmp_path, make):
    tables, workspace = fixtures.tables(spark, SF), Workspace(spark, "test")
    training = master.study_data(tables, RunParams(window=2, end_day=49, fixed_ending=49), workspace=workspace)
    testing, _ = master.study_data(tables, RunParams(window=2, end_day=56, fixed_ending=55, is_training=False), workspace=workspace)
    assert training.count() and testing.count()
    path = str(tmp_path / "folder")
    tables["person"].write.parquet(path)
    assert io.read_table(spark, "person", path, "parquet").count() == 150
    with pytest.raises(ValueError, match="age"):
        tables["person"].drop("age").write.parquet(path + "2")
        io.read_table(spark, "person", path + "2", "parquet")


def test_one_feature_row_per_person(spark):
    tables = fixtures.tables(spark, SF)
    for window in (1, 3):
        params = RunParams(window=window, end_day=49, fixed_ending=49)
        frame = master.StudyFrames(tables, params).features()
        assert frame.count() == frame.select("pid").distinct().count() == 150
        assert frame.columns == ["pid", *master.feature_columns(params)]


def test_prepared_cache_is_read_not_rebuilt(spark, tmp_path, make):
    path = str(tmp_path / "cache")
    one, two = (make("client_id long, x long", rows) for rows in ([(1, 5)], [(2, 6)]))
    first = io.read_or_build(spark, path, one.schema, lambda: one, "client_id")
    again = io.read_or_build(spark, path, two.schema, lambda: two, "client_id")
    assert rows_of(first) == rows_of(again) == [(1, 5)]
    assert first.schema["client_id"].dataType.simpleString() == "bigint"
