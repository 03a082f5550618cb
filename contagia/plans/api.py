"""Files in, model out; files and model in, predictions out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from contagia.operators import cohort
from contagia.params import FIT_PARAMS, PREDICT_PARAMS, RunParams
from contagia.plans import master, modelling
from contagia.sources import tables as io
from contagia.sources.schemas import FORMAT
from contagia.sources.workspace import Workspace


def _frames(tables: Mapping[str, DataFrame], params: RunParams, workspace: Workspace):
    timeline = workspace.durable(
        cohort.infection_timeline(tables["disease_outcome_training"]), "outcomes"
    )
    backdated = modelling.backdated_asymptomatic(
        tables["person"], timeline, params, workspace
    ).intervals
    return master.StudyFrames(tables, params, backdated=backdated, workspace=workspace,
                               timeline=timeline)


def train_risk_model(tables: Mapping[str, DataFrame], params: RunParams,
                     workspace: Workspace) -> modelling.RiskModel:
    """The whole training run on given tables."""
    frame = _frames(tables, params, workspace).training
    return modelling.fit_risk(frame, master.feature_columns(params), workspace)


def fit(spark: SparkSession, locations: Mapping[str, str], model_dir: str,
        params: RunParams = FIT_PARAMS) -> modelling.RiskModel:
    """Train on the given files and save the fitted pipeline below `model_dir`."""
    workspace = Workspace(spark, "fit")
    model = train_risk_model(io.load_tables(spark, locations), params, workspace)
    model.model.write().overwrite().save(f"{model_dir}/model")
    return model


def predict(spark: SparkSession, locations: Mapping[str, str], model_dir: str, format_path: str,
            destination: str, params: RunParams = PREDICT_PARAMS) -> DataFrame:
    """Score the test people of the given files; write one row per requested pid.

    The features always come from the given files, never from the tables of
    the training run.
    """
    workspace = Workspace(spark, "predict")
    scorer = modelling.model_scorer(PipelineModel.load(f"{model_dir}/model"))
    testing = _frames(io.load_tables(spark, locations), params, workspace).testing
    scores = modelling.score_people(scorer, testing)
    aligned = io.align_to_format(io.read_csv(spark, format_path, FORMAT), scores)
    io.write_predictions(aligned, destination)
    return io.read_csv(spark, destination, FORMAT)
