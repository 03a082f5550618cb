"""One entry per operator: (spark, sf_dir) -> DataFrame over the whole derived tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contagia.functions import metrics, ranking, scaling
from contagia.operators import cohort, exposure, flat, labels, lags
from contagia.params import FIT_PARAMS, PREDICT_PARAMS, FederatedParams, RunParams
from contagia.plans import api, daily, federated, master, modelling
from contagia.sources import fixtures, schemas
from contagia.sources import tables as io
from contagia.sources.workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TRAIN = RunParams(window=2, end_day=49, fixed_ending=49, is_training=True)
TEST = RunParams(window=2, end_day=56, fixed_ending=55, is_training=False)
FLAT_TEST = RunParams(window=2, end_day=50, fixed_ending=49, is_training=False)

# Weights of the fixed scorer used wherever a query needs scores to compare.
LINEAR_WEIGHTS = {
    "age": 0.01,
    "sex": -0.2,
    "infected_interactions_lag_day_0": 0.06,
    "infected_interactions_lag_day_1": 0.03,
    "infected_interactions_loc_lag_day_0": 0.004,
    "family_infected_lag_day_0": 0.5,
}
LINEAR_INTERCEPT = -1.2
TEXTBOOK = FederatedParams(noise=False)
PARITY = FederatedParams(noise=False, mode="parity")
CLIP_NORM = 0.5
SEED = 7
DIGITS = 6


def _query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function
    return register


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


class _Study:
    """The steps of a run over the derived tables, declared when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str, params: RunParams = TRAIN,
                 extra: bool = False) -> None:
        self.spark, self.sf_dir, self.params, self.extra = spark, sf_dir, params, extra

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        return fixtures.tables(self.spark, self.sf_dir)

    @cached_property
    def person(self) -> DataFrame:
        return fixtures.person(self.spark, self.sf_dir)

    @cached_property
    def visits(self) -> DataFrame:
        return fixtures.visits(self.spark, self.sf_dir)

    @cached_property
    def timeline(self) -> DataFrame:
        return cohort.infection_timeline(fixtures.disease(self.spark, self.sf_dir))

    @cached_property
    def silent(self) -> DataFrame:
        return cohort.asymptomatic_timeline(self.timeline, self.params)

    @cached_property
    def cohort(self) -> DataFrame:
        predicted = fixtures.extra_patients(self.spark, self.sf_dir) if self.extra else None
        return cohort.study_cohort(self.timeline, self.params, predicted)

    @cached_property
    def intervals(self) -> DataFrame:
        return cohort.infection_intervals(self.cohort)

    @cached_property
    def people(self) -> DataFrame:
        return cohort.susceptible(self.person, self.intervals, self.params)

    @cached_property
    def ahead(self) -> DataFrame:
        return cohort.susceptible(self.person, self.intervals, self.params, inference=True)

    @cached_property
    def current(self) -> DataFrame:
        return labels.positives_on_day(self.timeline, self.params.end_day)

    @cached_property
    def contacts(self) -> DataFrame:
        return exposure.contact_table(fixtures.network(self.spark, self.sf_dir), self.intervals)

    @cached_property
    def place_links(self) -> DataFrame:
        return exposure.place_links(self.visits)

    @cached_property
    def household_links(self) -> DataFrame:
        return exposure.household_links(self.person)

    def infected(self, links: DataFrame) -> DataFrame:
        windows = exposure.infected_windows(self.intervals, self.params.window)
        return exposure.shared_terms(links, self.intervals, windows, self.params.window)

    def everybody(self, links: DataFrame) -> DataFrame:
        windows = exposure.infected_windows(self.intervals, self.params.window).unionByName(
            exposure.fixed_windows(self.people)
        )
        return exposure.shared_terms(links, self.intervals, windows, self.params.window)

    def uninfected(self, links: DataFrame, inference: bool = False) -> DataFrame:
        p = self.params
        people = self.ahead if inference else self.people
        end = p.inference_window_end if inference else p.training_window_end
        return exposure.fixed_terms(links, self.intervals, people, p.window, end)


# ------------------------------------------------------------ A: sources, sinks


@_query("a1_csv_scan")
def _(spark, sf_dir):
    path = Workspace(spark, "csv").child("network")
    fixtures.network(spark, sf_dir).write.option("header", True).csv(path)
    return io.read_table(spark, "population_network", path)


@_query("a6_distinct_contacts")
def _(spark, sf_dir):
    return io.network_edges(fixtures.network(spark, sf_dir))


def _client_frame(spark, sf_dir, params=TRAIN) -> DataFrame:
    workspace = Workspace(spark, "flat")
    return federated.client_frame(fixtures.client_tables(spark, sf_dir), params, workspace)


@_query("a7_prepared_feature_cache")
def _(spark, sf_dir):
    path = Workspace(spark, "prepared").child("train")
    tables = fixtures.client_tables(spark, sf_dir)
    federated.prepared_frame(spark, tables, TRAIN, path)
    return federated.prepared_frame(spark, tables, TRAIN, path)


def _testing_scores(spark, sf_dir) -> DataFrame:
    tables = fixtures.tables(spark, sf_dir)
    testing, _ = master.study_data(tables, TEST, workspace=Workspace(spark, "testing"))
    return modelling.score_people(
        modelling.linear_scorer(LINEAR_WEIGHTS, LINEAR_INTERCEPT), testing
    )


@_query("a8_predictions_aligned")
def _(spark, sf_dir):
    path = Workspace(spark, "predictions").child("aligned")
    scores = io.align_to_format(
        fixtures.prediction_format(spark, sf_dir), _testing_scores(spark, sf_dir)
    )
    io.write_predictions(scores, path)
    return _rounded(io.read_csv(spark, path, schemas.FORMAT), "score")


@_query("a9_predictions_in_feature_order")
def _(spark, sf_dir):
    path = Workspace(spark, "predictions").child("plain")
    io.write_predictions(_testing_scores(spark, sf_dir), path)
    return _rounded(io.read_csv(spark, path, schemas.FORMAT), "score")


@_query("a10_saved_risk_model")
def _(spark, sf_dir):
    workspace = Workspace(spark, "model")
    tables = fixtures.tables(spark, sf_dir)
    frame = workspace.durable(master.study_data(tables, TRAIN, workspace=workspace), "training")
    model = modelling.fit_risk(frame, master.feature_columns(TRAIN), workspace).model
    model.write().overwrite().save(workspace.child("model"))
    loaded = modelling.PipelineModel.load(workspace.child("model"))
    before, after = (modelling.model_scorer(m)(frame).select("pid", "score") for m in (model, loaded))
    change = F.round(F.col("after") - F.col("before"), DIGITS).alias("change")
    return before.withColumnRenamed("score", "before").join(after.withColumnRenamed("score", "after"), "pid").select("pid", change)


# ------------------------------------------------------------------ B: cohorts


@_query("b1_recovered_timeline")
def _(spark, sf_dir):
    return cohort.recovered_timeline(_Study(spark, sf_dir).timeline, TRAIN)


@_query("b2_asymptomatic_timeline")
def _(spark, sf_dir):
    return _Study(spark, sf_dir).silent


@_query("b3a_recovery_training_features")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return cohort.recovery_features(s.person, cohort.recovered_timeline(s.timeline, TRAIN))


@_query("b3b_recovery_scoring_features")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return cohort.recovery_features(s.person, s.silent)


@_query("b4_backdated_by_model")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return modelling.backdated_asymptomatic(
        s.person, s.timeline, TRAIN, Workspace(spark, "backdate")
    ).intervals


@_query("b4_backdated_with_rare_value")
def _(spark, sf_dir):
    """One more person, whose recovery time nobody else has, does not turn the model off."""
    s = _Study(spark, sf_dir)
    person, timeline = fixtures.with_rare_recovery(s.person, s.timeline)
    return modelling.backdated_asymptomatic(
        person, timeline, TRAIN, Workspace(spark, "backdate-rare")
    ).intervals


@_query("b4f_backdated_by_constant")
def _(spark, sf_dir):
    return cohort.backdate(_Study(spark, sf_dir).silent)


@_query("b5_merged_cohort")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return cohort.merge_cohorts(s.timeline, cohort.backdate(s.silent), TRAIN)


@_query("b6_cohort_with_predicted")
def _(spark, sf_dir):
    return _Study(spark, sf_dir, extra=True).cohort


@_query("b7_infection_intervals")
def _(spark, sf_dir):
    return _Study(spark, sf_dir).intervals


@_query("b8_susceptible")
def _(spark, sf_dir):
    return _Study(spark, sf_dir).people


@_query("b9_susceptible_inference")
def _(spark, sf_dir):
    return _Study(spark, sf_dir).ahead


# ----------------------------------------------------------------- C: contacts


@_query("c1_contact_table")
def _(spark, sf_dir):
    return _Study(spark, sf_dir).contacts


@_query("c2a_contact_exposure_infected_side1")
def _(spark, sf_dir):
    return exposure.contact_side(_Study(spark, sf_dir).contacts, 1, TRAIN.window)


@_query("c2b_contact_exposure_infected_side2")
def _(spark, sf_dir):
    return exposure.contact_side(_Study(spark, sf_dir).contacts, 2, TRAIN.window)


@_query("c2_contact_exposure_infected")
def _(spark, sf_dir):
    return exposure.contact_exposure(_Study(spark, sf_dir).contacts, TRAIN.window)


@_query("c3a_contact_exposure_uninfected_side1")
def _(spark, sf_dir):
    contacts = _Study(spark, sf_dir).contacts
    return exposure.contact_side(contacts, 1, TRAIN.window, TRAIN.training_window_end)


@_query("c3b_contact_exposure_uninfected_side2")
def _(spark, sf_dir):
    contacts = _Study(spark, sf_dir).contacts
    return exposure.contact_side(contacts, 2, TRAIN.window, TRAIN.training_window_end)


@_query("c3_contact_exposure_uninfected")
def _(spark, sf_dir):
    contacts = _Study(spark, sf_dir).contacts
    return exposure.contact_exposure(contacts, TRAIN.window, TRAIN.training_window_end)


@_query("c4_contact_exposure_inference")
def _(spark, sf_dir):
    contacts = _Study(spark, sf_dir).contacts
    return exposure.contact_exposure(contacts, TRAIN.window, TRAIN.inference_window_end)


@_query("c5_contact_exposure_all")
def _(spark, sf_dir):
    return exposure.all_contact_exposure(_Study(spark, sf_dir).contacts, TRAIN)


@_query("c6_contact_lags")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return master.contact_lags(s.tables, s.intervals, TRAIN)


@_query("c6_contact_lags_inference")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return master.contact_lags(s.tables, s.intervals, TRAIN, inference=True)


# ------------------------------------------------------------------- D: places


@_query("d1a_visits_infected")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return exposure.visits_with_interval(s.visits, s.intervals)


@_query("d1b_visits_susceptible")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return exposure.visits_with_interval(s.visits, s.people)


@_query("d1c_visits_susceptible_inference")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return exposure.visits_with_interval(s.visits, s.ahead)


@_query("d2_place_exposure_infected")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return exposure.place_exposure(s.infected(s.place_links))


@_query("d3_place_exposure_uninfected")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return exposure.place_exposure(s.uninfected(s.place_links))


@_query("d4_place_exposure_inference")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return exposure.place_exposure(s.uninfected(s.place_links, True))


@_query("d5_place_totals")
def _(spark, sf_dir):
    return _rounded(exposure.place_totals(fixtures.visits(spark, sf_dir)), "total_interaction_loc")


@_query("d6_place_exposure_all")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return exposure.place_exposure(s.everybody(s.place_links))


@_query("d7_place_lags")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return master.place_lags(s.tables, s.intervals, TRAIN)


@_query("d7_place_lags_inference")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return master.place_lags(s.tables, s.intervals, TRAIN, inference=True)


# --------------------------------------------------------------- E: households


@_query("e0_infected_people")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return s.person.join(s.intervals, "pid").select(*s.person.columns, "first_day", "last_day")


@_query("e1_household_exposure_infected")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return exposure.household_exposure(s.infected(s.household_links))


@_query("e2_household_exposure_uninfected")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return exposure.household_exposure(s.uninfected(s.household_links))


@_query("e3_household_exposure_inference")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return exposure.household_exposure(s.uninfected(s.household_links, True))


@_query("e4_household_exposure_all")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return exposure.household_exposure(s.everybody(s.household_links))


@_query("e5_household_lags")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return master.household_lags(s.tables, s.intervals, TRAIN)


@_query("e5_household_lags_inference")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return master.household_lags(s.tables, s.intervals, TRAIN, inference=True)


# -------------------------------------------------------------------- F: lags


@_query("f1_lag_pivot")
def _(spark, sf_dir):
    wide = RunParams(window=5, end_day=49, fixed_ending=49)
    s = _Study(spark, sf_dir, wide)
    rows = exposure.contact_exposure(s.contacts, wide.window)
    return lags.lag_pivot(rows, "total_interactions", lags.CONTACT, wide.window)


# ------------------------------------------------------- G: labels and masters


@_query("g1_training_labels")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return labels.training_labels(s.intervals, s.people, TRAIN)


@_query("g2_positives_on_day")
def _(spark, sf_dir):
    return _Study(spark, sf_dir, TEST).current


@_query("g3_testing_labels")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir, TEST)
    return labels.testing_labels(s.intervals, s.people, s.current)


@_query("g4_inference_set")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir, TEST)
    return labels.inference_set(s.people, s.current)


@_query("g5_person_features")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return master.person_features(s.person, master.lag_tables(s.tables, s.intervals, TRAIN))


@_query("g5_person_features_inference")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return master.person_features(
        s.person, master.lag_tables(s.tables, s.intervals, TRAIN, inference=True)
    )


@_query("g6_master_training")
def _(spark, sf_dir):
    workspace = Workspace(spark, "study")
    return master.StudyFrames(fixtures.tables(spark, sf_dir), TRAIN, workspace=workspace).training


@_query("g6_master_testing")
def _(spark, sf_dir):
    workspace = Workspace(spark, "study")
    return master.StudyFrames(fixtures.tables(spark, sf_dir), TEST, workspace=workspace).testing


@_query("g6_master_inference")
def _(spark, sf_dir):
    workspace = Workspace(spark, "study")
    return master.StudyFrames(fixtures.tables(spark, sf_dir), TEST, workspace=workspace).inference


@_query("g7_master_by_mode")
def _(spark, sf_dir):
    tables = fixtures.tables(spark, sf_dir)
    testing, inference = master.study_data(tables, TEST, workspace=Workspace(spark, "study"))
    return testing.withColumn("frame", F.lit("testing")).unionByName(
        inference.withColumn("frame", F.lit("inference"))
    )


@_query("g8_study_with_predicted")
def _(spark, sf_dir):
    extra = fixtures.extra_patients(spark, sf_dir)
    return master.study_data(
        fixtures.tables(spark, sf_dir), TRAIN, extra, workspace=Workspace(spark, "study")
    )


# --------------------------------------------------------- H: flat feature set


def _flat(spark, sf_dir):
    tables = fixtures.tables(spark, sf_dir)
    return tables["person"], tables["population_network"], tables["disease_outcome_training"]


@_query("h1_affected_cohort")
def _(spark, sf_dir):
    return flat.affected_cohort(_flat(spark, sf_dir)[2], TRAIN)


@_query("h2_contact_days")
def _(spark, sf_dir):
    _, network, states = _flat(spark, sf_dir)
    return flat.edge_days(network, flat.affected_cohort(states, TRAIN))


def _onset_flags(spark, sf_dir) -> DataFrame:
    _, network, states = _flat(spark, sf_dir)
    days = flat.edge_days(network, flat.affected_cohort(states, TRAIN))
    return flat.transmission_flags(days, TRAIN.window)


@_query("h3_transmission_flags")
def _(spark, sf_dir):
    return _onset_flags(spark, sf_dir)


@_query("h4_contact_counts")
def _(spark, sf_dir):
    return flat.contact_counts(_onset_flags(spark, sf_dir))


@_query("h5_place_infections")
def _(spark, sf_dir):
    return flat.place_infections(_onset_flags(spark, sf_dir))


@_query("h6_person_place_infections")
def _(spark, sf_dir):
    return flat.person_place_infections(_onset_flags(spark, sf_dir))


@_query("h7_infected_features")
def _(spark, sf_dir):
    _, network, states = _flat(spark, sf_dir)
    return flat.infected_features(network, states, TRAIN)


@_query("h8_recent_infection_flag")
def _(spark, sf_dir):
    person, _, states = _flat(spark, sf_dir)
    return flat.person_infection_flag(person, states, TRAIN)


@_query("h9_uninfected_features")
def _(spark, sf_dir):
    return flat.uninfected_features(*_flat(spark, sf_dir), TRAIN)


@_query("h10_flat_frame_training")
def _(spark, sf_dir):
    return flat.flat_frame(*_flat(spark, sf_dir), TRAIN, workspace=Workspace(spark, "flat"))


@_query("h10_flat_frame_testing")
def _(spark, sf_dir):
    return flat.flat_frame(*_flat(spark, sf_dir), FLAT_TEST, workspace=Workspace(spark, "flat"))


@_query("h11_true_labels")
def _(spark, sf_dir):
    return flat.true_labels(_flat(spark, sf_dir)[2])


@_query("h12_status_on_day")
def _(spark, sf_dir):
    person, _, states = _flat(spark, sf_dir)
    return flat.status_on_day(person, states)


# ------------------------------------------------------------------- I: models


@_query("i1_standardised_features")
def _(spark, sf_dir):
    workspace = Workspace(spark, "flat")
    frame = workspace.durable(
        flat.flat_frame(*_flat(spark, sf_dir), TRAIN, workspace=workspace), "frame"
    )
    columns = flat.FLAT_FEATURES
    scaled = scaling.fit_scaler(frame, columns).apply(frame)
    names = [scaling.z_name(c) for c in columns]
    return _rounded(scaled.select("pid", *names), *names)


@_query("i2_stratified_split")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    return ranking.stratified_split(labels.training_labels(s.intervals, s.people, TRAIN), "covid")


@_query("i3_recovery_regression")
def _(spark, sf_dir):
    s = _Study(spark, sf_dir)
    known = cohort.recovered_timeline(s.timeline, TRAIN)
    model = modelling.fit_recovery(
        cohort.recovery_features(s.person, known), Workspace(spark, "recovery")
    )
    values = dict(zip(["intercept", *modelling.RECOVERY_FEATURES], model.coefficients()))
    values |= {"mse_train": model.mse_train, "mse_test": model.mse_test}
    rows = [(name, round(value, DIGITS)) for name, value in values.items()]
    return spark.createDataFrame(rows, "name string, value double")


@_query("i4_risk_model_quality")
def _(spark, sf_dir):
    workspace = Workspace(spark, "risk")
    frame = master.study_data(fixtures.tables(spark, sf_dir), TRAIN, workspace=workspace)
    model = modelling.fit_risk(frame, master.feature_columns(TRAIN), workspace)
    values = {"auprc_train": model.auprc_train, "auprc_test": model.auprc_test, "intercept": model.intercept}
    values |= dict(zip(master.feature_columns(TRAIN), model.weights))
    return spark.createDataFrame([(name, round(value, DIGITS)) for name, value in values.items()], "name string, value double")


@_query("i5_scored_people")
def _(spark, sf_dir):
    return _rounded(_testing_scores(spark, sf_dir), "score")


@_query("i6_trained_risk_model")
def _(spark, sf_dir):
    workspace = Workspace(spark, "train")
    tables = fixtures.tables(spark, sf_dir)
    model = api.train_risk_model(tables, TRAIN, workspace)
    frame = master.study_data(tables, TRAIN, workspace=workspace.sub("scoring"))
    return _rounded(modelling.score_people(modelling.model_scorer(model.model), frame), "score")


@_query("i7_fit_and_predict")
def _(spark, sf_dir):
    workspace = Workspace(spark, "study-files")
    locations = {}
    for name, frame in fixtures.tables(spark, sf_dir).items():
        locations[name] = workspace.child(f"{name}.csv")
        frame.write.option("header", True).csv(locations[name])
    requested = workspace.child("format.csv")
    fixtures.prediction_format(spark, sf_dir).write.option("header", True).csv(requested)
    api.fit(spark, locations, workspace.child("model"), FIT_PARAMS)
    predicted = api.predict(
        spark, locations, workspace.child("model"), requested, workspace.child("predictions"),
        PREDICT_PARAMS,
    )
    return _rounded(predicted, "score")


@_query("i8_predicted_patients")
def _(spark, sf_dir):
    scorer = modelling.linear_scorer(LINEAR_WEIGHTS, LINEAR_INTERCEPT)
    tables = fixtures.tables(spark, sf_dir)
    return daily.forecast_day(
        tables, TEST, scorer, workspace=Workspace(spark, "forecast")
    ).new_patients


@_query("i8_day_quality")
def _(spark, sf_dir):
    scorer = modelling.linear_scorer(LINEAR_WEIGHTS, LINEAR_INTERCEPT)
    day = daily.forecast_day(
        fixtures.tables(spark, sf_dir), TEST, scorer, workspace=Workspace(spark, "quality")
    )
    return _rounded(day.quality, "average_precision", "precision", "recall")


@_query("i8_daily_loop")
def _(spark, sf_dir):
    scorer = modelling.linear_scorer(LINEAR_WEIGHTS, LINEAR_INTERCEPT)
    first, second = daily.forecast_days(
        fixtures.tables(spark, sf_dir), TEST, scorer, [55, 56], Workspace(spark, "daily")
    )
    return first.new_patients.unionByName(second.new_patients)


# ------------------------------------------------------------------ J: metrics


def _scored(spark, sf_dir, clients: bool = False) -> DataFrame:
    """A stored table of scores, as metrics are taken of."""
    workspace = Workspace(spark, "scored")
    if clients:
        frame = federated.client_frame(fixtures.client_tables(spark, sf_dir), TRAIN, workspace)
    else:
        frame = flat.flat_frame(*_flat(spark, sf_dir), TRAIN, workspace=workspace)
    z = 0.8 - 0.05 * F.col("infect_pat") + 0.002 * F.col("family_infect")
    keys = ["client_id"] if clients else []
    score = F.round(1 / (1 + F.exp(-z)), DIGITS).alias("score")
    return workspace.durable(frame.select(*keys, "pid", "covid", score), "scores")


@_query("j1_average_precision")
def _(spark, sf_dir):
    return _rounded(
        metrics.average_precision(_scored(spark, sf_dir), "covid", "score"), "average_precision"
    )


@_query("j1_average_precision_by_client")
def _(spark, sf_dir):
    scored = _scored(spark, sf_dir, True)
    return _rounded(
        metrics.average_precision(scored, "covid", "score", ["client_id"]), "average_precision"
    )


@_query("j2_precision_recall")
def _(spark, sf_dir):
    return _rounded(
        metrics.precision_recall(_scored(spark, sf_dir), "covid", "score", 0.5), "precision", "recall"
    )


@_query("j3_log_loss")
def _(spark, sf_dir):
    return _rounded(metrics.log_loss(_scored(spark, sf_dir), "covid", "score"), "log_loss")


@_query("j4_mean_squared_error")
def _(spark, sf_dir):
    return _rounded(metrics.mean_squared_error(_scored(spark, sf_dir), "covid", "score"), "mse")


@_query("j5_accuracy")
def _(spark, sf_dir):
    return _rounded(metrics.accuracy(_scored(spark, sf_dir), "covid", "score"), "accuracy")


@_query("j5_accuracy_single_column_argmax")
def _(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    return _rounded(
        metrics.accuracy(scored, "covid", "score", single_column_argmax=True), "accuracy"
    )


@_query("j6_bce_with_logits")
def _(spark, sf_dir):
    return _rounded(metrics.bce_with_logits(_scored(spark, sf_dir), "covid", "score"), "bce_loss")


@_query("j6_bce_second_sigmoid")
def _(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    return _rounded(
        metrics.bce_with_logits(scored, "covid", "score", second_sigmoid=True), "bce_loss"
    )


@_query("j7_weighted_average")
def _(spark, sf_dir):
    scored = _scored(spark, sf_dir, True)
    per_client = metrics.accuracy(scored, "covid", "score", groups=["client_id"]).join(
        scored.groupBy("client_id").agg(F.count(F.lit(1)).alias("n")), "client_id"
    )
    return _rounded(metrics.weighted_average(per_client, "accuracy"), "accuracy")


# ---------------------------------------------------------------- K: federated


@_query("k1_client_features")
def _(spark, sf_dir):
    return _client_frame(spark, sf_dir)


class _Federation:
    """Stored features and scaled, split rows of all clients."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.workspace = Workspace(spark, "federation")
        self.frame = federated.prepared_frame(
            spark, fixtures.client_tables(spark, sf_dir), TRAIN, self.workspace.child("prepared")
        )

    @cached_property
    def rows(self) -> DataFrame:
        return federated.split(federated.standardised(self.frame, self.workspace, "scaler"))

    def train_rows(self, batch_size: int = 128) -> DataFrame:
        return self.workspace.durable(
            federated.batch_weights(self.rows.where(F.col("is_test") == 0), batch_size), "train"
        )

    def epoch(self, config: FederatedParams) -> DataFrame:
        """Every client's weights after its first epoch."""
        rows = self.train_rows(config.batch_size)
        zero = self.workspace.durable(federated.zero_params(rows), "zero")
        return federated.local_epoch(rows, zero, zero, config)


_Z = [scaling.z_name(c) for c in flat.FLAT_FEATURES]


@_query("k2_client_standardised_split")
def _(spark, sf_dir):
    rows = _Federation(spark, sf_dir).rows
    return _rounded(rows.select("client_id", "pid", "covid", *_Z, "is_test"), *_Z)


@_query("k2_test_rows_own_scaler")
def _(spark, sf_dir):
    workspace = Workspace(spark, "federation")
    frame = workspace.durable(_client_frame(spark, sf_dir, FLAT_TEST), "prepared")
    scaled = federated.standardised(frame, workspace, "scaler")
    return _rounded(scaled.select("client_id", "pid", *_Z), *_Z)


@_query("k3_zero_params")
def _(spark, sf_dir):
    return federated.zero_params(_Federation(spark, sf_dir).frame)


@_query("k4_local_epoch_textbook")
def _(spark, sf_dir):
    return _rounded(_Federation(spark, sf_dir).epoch(TEXTBOOK), "value")


@_query("k4_local_epoch_parity")
def _(spark, sf_dir):
    return _rounded(_Federation(spark, sf_dir).epoch(PARITY), "value")


@_query("k5_proximal_gradient")
def _(spark, sf_dir):
    f = _Federation(spark, sf_dir)
    rows = f.train_rows()
    zero = f.workspace.durable(federated.zero_params(rows), "zero")
    local = f.workspace.durable(zero.withColumn("value", 0.1 * (F.col("idx") + 1)), "local")
    gradient = federated.proximal_gradient(
        federated.epoch_gradient(rows, zero), local, zero, TEXTBOOK.mu
    )
    loss = federated.proximal_loss(local, zero, TEXTBOOK.mu)
    return _rounded(
        gradient.join(loss, "client_id").select("client_id", "idx", "gradient", "proximal_loss"),
        "gradient", "proximal_loss",
    )


@_query("k6_clipped_gradient")
def _(spark, sf_dir):
    f = _Federation(spark, sf_dir)
    rows = f.train_rows()
    zero = f.workspace.durable(federated.zero_params(rows), "zero")
    gradient = federated.clip_gradient(federated.epoch_gradient(rows, zero), CLIP_NORM)
    return _rounded(gradient.select("client_id", "idx", "gradient"), "gradient")


@_query("k7_gaussian_mechanism")
def _(spark, sf_dir):
    return _rounded(_Federation(spark, sf_dir).epoch(FederatedParams(seed=SEED)), "value")


@_query("k8_federated_average")
def _(spark, sf_dir):
    return _rounded(federated.fed_avg(_Federation(spark, sf_dir).epoch(TEXTBOOK)), "value")


def _evaluation(spark, sf_dir) -> tuple[_Federation, DataFrame]:
    f = _Federation(spark, sf_dir)
    shared = federated.fed_avg(f.epoch(TEXTBOOK)).orderBy("idx").collect()  # features + 1 rows
    return f, federated.score(f.rows, [r["value"] for r in shared])


@_query("k9_federated_evaluation")
def _(spark, sf_dir):
    f, scored = _evaluation(spark, sf_dir)
    held_out = scored.where(F.col("is_test") == 1).withColumn("score", F.round("score", 9))
    held_out = f.workspace.durable(held_out, "held-out")
    per_client = federated.evaluate(held_out)
    columns = {f"overall_{m}": federated.overall(per_client, f"{m}").scalar() for m in ("bce_loss", "accuracy")}
    return _rounded(per_client.withColumns(columns), "bce_loss", "average_precision", "accuracy", *columns)


@_query("k9_federated_training")
def _(spark, sf_dir):
    workspace = Workspace(spark, "federated")
    _, evaluation = federated.fit_clients(
        spark, fixtures.client_tables(spark, sf_dir), workspace.child("prepared"),
        workspace.child("rounds"), replace(TEXTBOOK, epochs=2, rounds=2), TRAIN,
    )
    return _rounded(evaluation, "bce_loss", "average_precision", "accuracy")


def _default_training(spark, sf_dir) -> tuple[federated.FederatedModel, DataFrame, Workspace]:
    """Five epochs with noise, as published, but for a given seed."""
    workspace = Workspace(spark, "federated")
    model, evaluation = federated.fit_clients(
        spark, fixtures.client_tables(spark, sf_dir), workspace.child("prepared"),
        workspace.child("rounds"), FederatedParams(seed=SEED), TRAIN,
    )
    return model, evaluation, workspace


@_query("k9_default_training")
def _(spark, sf_dir):
    _, evaluation, _ = _default_training(spark, sf_dir)
    return _rounded(evaluation, "bce_loss", "average_precision", "accuracy")


@_query("k7_default_weights")
def _(spark, sf_dir):
    _, _, workspace = _default_training(spark, sf_dir)
    return _rounded(federated.load_rounds(spark, workspace.child("rounds")), "value")


@_query("k7_privacy_spent")
def _(spark, sf_dir):
    f = _Federation(spark, sf_dir)
    spent = federated.privacy_spent(f.train_rows(), FederatedParams(rounds=3))
    return _rounded(spent, "epsilon", "delta", "tight_epsilon")


def _predicted(spark, sf_dir, own_scaling: bool = False) -> tuple[DataFrame, DataFrame]:
    """Fit, save, load and score the test people of all clients: (scores, what was written)."""
    workspace, tables = Workspace(spark, "clients"), fixtures.client_tables(spark, sf_dir)
    # the contacts are joined together once, for the digests and features of both runs
    tables["population_network"] = workspace.durable(tables["population_network"], "network")
    features, model, out = (workspace.child(c) for c in ("features", "model", "predictions"))
    federated.fit_clients(spark, tables, features, model, replace(TEXTBOOK, epochs=1), TRAIN)
    scored = federated.predict_clients(spark, tables, features, model, out, FLAT_TEST, own_scaling)
    schema = "pid long, score double, client_id long"
    return scored, spark.read.schema(schema).option("header", True).csv(out).select("client_id", "pid", "score")


@_query("k10_client_predictions")
def _(spark, sf_dir):
    return _rounded(_predicted(spark, sf_dir)[1], "score")


@_query("k10_predictions_own_scaling")
def _(spark, sf_dir):
    return _rounded(_predicted(spark, sf_dir, True)[1], "score")


@_query("k10_outcome_precision")
def _(spark, sf_dir):
    scored, _ = _predicted(spark, sf_dir)
    stored = Workspace(spark, "judged").durable(scored.withColumn("score", F.round("score", 9)), "scores")
    states = fixtures.disease(spark, sf_dir, True)
    return _rounded(federated.outcome_precision(stored, states), "average_precision")


@_query("k10_saved_rounds")
def _(spark, sf_dir):
    f = _Federation(spark, sf_dir)
    rows = f.rows.where(F.col("is_test") == 0)
    model = federated.train(rows, replace(TEXTBOOK, epochs=1), f.workspace)
    path = f.workspace.child("rounds")
    federated.save_rounds(model, path)
    return _rounded(federated.load_rounds(spark, path), "value")


@_query("k11_equal_parts")
def _(spark, sf_dir):
    return ranking.equal_parts(fixtures.person(spark, sf_dir).select("pid"), 7)
