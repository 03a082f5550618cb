"""Recovery-time regression and risk classification as saveable pipelines."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contagia.functions import metrics
from contagia.functions.logistic import LogisticFit, fit_logistic
from contagia.functions.ranking import stratified_split
from contagia.functions.scaling import fit_scaler, z_name
from contagia.operators import cohort
from contagia.params import RunParams
from contagia.sources.workspace import Workspace

RECOVERY_FEATURES = ("sex", "age", "total_family_members")
Scorer = Callable[[DataFrame], DataFrame]


def _prepare(df: DataFrame, columns: Sequence[str]) -> list:
    """Null fill, z-scores from `df`, and the feature vector."""
    return [
        SQLTransformer(statement=fit_scaler(df, columns).statement()),
        VectorAssembler(inputCols=[z_name(c) for c in columns], outputCol="features"),
    ]


# ------------------------------------------------------------ recovery time


@dataclass(frozen=True)
class RecoveryModel:
    """`mse_test` is None where no recovery time has a row to spare for testing."""

    model: PipelineModel
    mse_train: float
    mse_test: float | None

    def coefficients(self) -> list[float]:
        fitted = self.model.stages[-1]
        return [float(fitted.intercept), *map(float, fitted.coefficients)]


def recovery_split(features: DataFrame) -> DataFrame:
    """The stratified split by recovery time; a time that occurs once belongs to the training part."""
    label = "recovery_time"
    lone = features.groupBy(F.col(label).alias("_time")).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1")
    rows = stratified_split(features, label)
    return (
        rows.join(lone, rows[label] == lone["_time"], "left")
        .withColumn("is_test", F.when(F.col("_n") == 1, F.lit(0)).otherwise(F.col("is_test")).cast("long"))
        .drop("_time", "_n")
    )


def fit_recovery(features: DataFrame, workspace: Workspace) -> RecoveryModel | None:
    """Linear model of days to recovery, fitted on all rows; None only if there is no row.

    The split fit only serves the reported errors.
    """
    rows = workspace.durable(recovery_split(features), "recovery-rows")
    if rows.isEmpty():
        return None
    prepared = Pipeline(stages=_prepare(rows, RECOVERY_FEATURES)).fit(rows)
    vectors = prepared.transform(rows)
    regression = LinearRegression(
        labelCol="recovery_time", regParam=0.0, standardization=False, solver="normal"
    )
    checked = regression.fit(vectors.where(F.col("is_test") == 0)).transform(vectors)
    by_part = metrics.mean_squared_error(checked, "recovery_time", "prediction", ["is_test"])
    errors = {row["is_test"]: row["mse"] for row in by_part.collect()}  # two rows
    model = PipelineModel([*prepared.stages, regression.fit(vectors)])
    return RecoveryModel(model, errors[0], errors.get(1))


def backdate_with_model(model: RecoveryModel, features: DataFrame) -> DataFrame:
    """First day of asymptomatic people from the predicted, half-even rounded recovery time."""
    days = F.bround("prediction", 0).cast("long")
    return model.model.transform(features).select(
        "pid", (F.col("last_day") - days).alias("first_day"), "last_day"
    )


@dataclass(frozen=True)
class Backdated:
    """Asymptomatic intervals, and whether they come from the model or from the constant."""

    intervals: DataFrame
    by_model: bool


def backdated_asymptomatic(person: DataFrame, timeline: DataFrame, params: RunParams,
                           workspace: Workspace) -> Backdated:
    """Asymptomatic intervals by the fitted model. The constant of two days is used
    only where nobody has a complete illness to learn from."""
    silent = cohort.asymptomatic_timeline(timeline, params)
    known = cohort.recovered_timeline(timeline, params)
    model = fit_recovery(cohort.recovery_features(person, known), workspace)
    if model is None:
        return Backdated(cohort.backdate(silent), False)
    return Backdated(backdate_with_model(model, cohort.recovery_features(person, silent)), True)


# ----------------------------------------------------------- risk of illness


@dataclass(frozen=True)
class RiskModel:
    """A saveable pipeline that adds `score`, and what was fitted."""

    model: PipelineModel
    intercept: float
    weights: tuple[float, ...]
    auprc_train: float
    auprc_test: float


def _score_stage(fit: LogisticFit, features: Sequence[str]) -> SQLTransformer:
    """The probability of the positive class from z-scores, as SQL."""
    terms = [f"({fit.intercept!r}D)", *(f"({w!r}D) * {z_name(c)}" for c, w in zip(features, fit.weights))]
    return SQLTransformer(statement=f"SELECT *, 1.0D / (1.0D + exp(-({' + '.join(terms)}))) AS score FROM __THIS__")


def fit_risk(frame: DataFrame, features: Sequence[str], workspace: Workspace,
             label: str = "covid", penalty: float = 1.0) -> RiskModel:
    """Logistic model on z-scores, fitted on 90 % of each class by Newton steps.

    The penalty is on the squared weights, not on the intercept. The split rows
    are stored first, as each step reads them once. Average precision is taken
    of scores at nine decimals, so that equal people tie.
    """
    rows = workspace.durable(
        stratified_split(frame.select("pid", label, *features), label), "risk-rows"
    )
    scale = SQLTransformer(statement=fit_scaler(rows, features).statement())
    scaled = scale.transform(rows)
    fit = fit_logistic(scaled.where(F.col("is_test") == 0), [z_name(c) for c in features], label, penalty)
    model = PipelineModel([scale, _score_stage(fit, features)])
    scored = workspace.durable(
        model.transform(rows).select(label, "is_test", F.round("score", 9).alias("score")), "risk-scores"
    )
    ranked = metrics.average_precision(scored, label, "score", ["is_test"])
    quality = {row["is_test"]: row["average_precision"] for row in ranked.collect()}  # two rows
    return RiskModel(model, fit.intercept, fit.weights, quality.get(0, 0.0), quality.get(1, 0.0))


def model_scorer(model: PipelineModel) -> Scorer:
    """Adds `score`, the probability of the positive class."""
    return lambda frame: model.transform(frame).select(*frame.columns, "score")


def linear_scorer(weights: Mapping[str, float], intercept: float = 0.0) -> Scorer:
    """Adds `score` from given weights; null features count as 0."""
    def apply(frame: DataFrame) -> DataFrame:
        z = F.lit(float(intercept))
        for column, weight in weights.items():
            z = z + F.lit(float(weight)) * F.coalesce(F.col(column).cast("double"), F.lit(0.0))
        return frame.withColumn("score", 1 / (1 + F.exp(-z)))
    return apply


def score_people(scorer: Scorer, frame: DataFrame, threshold: float = 0.5,
                 label: str = "covid") -> DataFrame:
    """pid, thresholded prediction, score and truth."""
    return scorer(frame).select(
        "pid",
        F.when(F.col("score") >= threshold, 1).otherwise(0).cast("long").alias("covid_predicted"),
        "score",
        F.col(label).alias("covid_ground_truth"),
    )


def score_quality(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Average precision, precision and recall of a prediction table, as one row."""
    label, score = "covid_ground_truth", "score"
    ranked = metrics.average_precision(predictions, label, score)
    cut = metrics.precision_recall(predictions, label, score, threshold)
    return cut.select(ranked.scalar().alias("average_precision"), "precision", "recall")
