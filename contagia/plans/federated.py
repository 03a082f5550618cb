"""Federated logistic regression: clients are groups of rows, not processes.

Each client trains on its own rows; all clients take each step in the same
job. What travels between steps is a parameter table of clients x (features + 1)
numbers, written to shared storage after each epoch, so that any lost work is
redone from the last epoch and the planner sees the table's true size.
"""

from __future__ import annotations

import secrets
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contagia.functions import metrics
from contagia.functions.joins import spread_join
from contagia.functions.ranking import stratified_split, with_position
from contagia.functions.scaling import apply_group_statistics, group_statistics, z_name
from contagia.operators.flat import FLAT_FEATURES, flat_frame, true_labels
from contagia.params import FLAT_TEST_PARAMS, FLAT_TRAIN_PARAMS, FederatedParams, RunParams
from contagia.sources import tables as io
from contagia.sources.workspace import Workspace

CLIENT = "client_id"
LABEL = "covid"
_SHIFT = 2.0**52


# ----------------------------------------------------------------- features


def client_frame(tables: Mapping[str, DataFrame], params: RunParams,
                 workspace: Workspace | None = None) -> DataFrame:
    """Flat features of all clients, each from its own rows."""
    return flat_frame(
        tables["person"], tables["population_network"], tables["disease_outcome_training"],
        params, (CLIENT,), workspace, stepwise=workspace is not None,
    )


#: The tables that the client features are made of.
INPUTS = ("person", "population_network", "disease_outcome_training")


def prepared_path(path: str, params: RunParams, inputs: str) -> str:
    """Features of other run parameters or other input rows lie in another folder, so none are taken for another's."""
    mode = "training" if params.is_training else "testing"
    return (f"{path}/window={params.window},end={params.end_day},fixed={params.fixed_ending},"
            f"forward={params.look_forward},{mode},inputs={inputs}")


def prepared_frame(spark: SparkSession, tables: Mapping[str, DataFrame], params: RunParams,
                   path: str) -> DataFrame:
    """The client features below `path`, built and written there on first use with these parameters and inputs.

    The steps of the build are deleted, since the features are read from `path`."""
    schema = client_frame(tables, params).schema  # declared only, nothing runs
    workspace = Workspace(spark, "client-status")
    frame = io.read_or_build(
        spark, prepared_path(path, params, io.fingerprint(tables, INPUTS)), schema,
        lambda: client_frame(tables, params, workspace), CLIENT,
    )
    workspace.clear()
    return frame


def standardised(frame: DataFrame, workspace: Workspace, name: str,
                 columns: Sequence[str] = FLAT_FEATURES, stats: DataFrame | None = None) -> DataFrame:
    """z-scores per client, by stored statistics (default: those of `frame` itself)."""
    if stats is None:
        stats = workspace.durable(group_statistics(frame, columns, [CLIENT]), name)
    return apply_group_statistics(frame, stats, columns, [CLIENT])


def split(frame: DataFrame, test_share: float = 0.1) -> DataFrame:
    """Per client and class, the same share of test rows."""
    return stratified_split(frame, LABEL, [CLIENT], test_share)


# --------------------------------------------------------------- parameters


def zero_params(frame: DataFrame, columns: Sequence[str] = FLAT_FEATURES) -> DataFrame:
    """All-zero weights per client (the last index is the intercept), with the client's row count."""
    index = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(columns)).cast("long")))
    return (
        frame.groupBy(CLIENT)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(CLIENT, index.alias("idx"), F.lit(0.0).alias("value"), "n")
    )


def _as_arrays(params: DataFrame) -> DataFrame:
    """One row per client with its weights in index order."""
    pairs = F.sort_array(F.collect_list(F.struct("idx", "value")))
    return params.groupBy(CLIENT).agg(F.transform(pairs, lambda p: p["value"]).alias("weights"))


# ---------------------------------------------------------------- training


def batch_weights(train: DataFrame, batch_size: int) -> DataFrame:
    """Give each row 1 / (size of its batch); batches are cut in hash order per client.

    `last_batch` and `batches` describe the client's epoch.
    """
    ranked = with_position(train, [CLIENT])
    size = F.col("_group_size")
    batches = F.ceil(size / batch_size)
    last = size - (batches - 1) * batch_size
    index = F.ceil(F.col("_position") / batch_size)
    own = F.when(index == batches, last).otherwise(F.lit(batch_size))
    return ranked.select(
        "*",
        (1.0 / own).alias("row_weight"),
        last.cast("long").alias("last_batch"),
        batches.cast("long").alias("batches"),
    ).drop("_position", "_group_size")


def _logit(columns: Sequence[str], weight: Sequence[Column]) -> Column:
    z = weight[len(columns)]
    for j, column in enumerate(columns):
        z = z + F.col(z_name(column)) * weight[j]
    return z


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def epoch_gradient(rows: DataFrame, params: DataFrame, columns: Sequence[str] = FLAT_FEATURES,
                   mode: str = "textbook") -> DataFrame:
    """Sum over the batches of an epoch of the batch-mean gradient, per client.

    One map-side combined aggregation. textbook: p - y. parity: the loss
    applies a second sigmoid, so its derivative is (sigmoid(p) - y) p (1 - p).
    """
    width = len(columns)
    joined = spread_join(rows, _as_arrays(params), [CLIENT], ["pid"])
    weight = [F.get("weights", F.lit(j)) for j in range(width + 1)]
    p = F.col("_p")
    error = p - F.col(LABEL) if mode == "textbook" else (_sigmoid(p) - F.col(LABEL)) * p * (1 - p)
    pulled = (
        joined.withColumn("_p", _sigmoid(_logit(columns, weight)))
        .withColumn("_pull", F.col("row_weight") * error)
    )
    inputs = [F.col(z_name(c)) for c in columns] + [F.lit(1.0)]
    sums = [F.sum(F.col("_pull") * x).alias(f"_g{j}") for j, x in enumerate(inputs)]
    per_client = pulled.groupBy(CLIENT).agg(
        *sums, F.count(F.lit(1)).alias("n"), F.first("last_batch").alias("last_batch"),
        F.first("batches").alias("batches"),
    )
    gradient = F.posexplode(F.array(*[f"_g{j}" for j in range(width + 1)])).alias("idx", "gradient")
    return per_client.select(CLIENT, "n", "last_batch", "batches", gradient).withColumn(
        "idx", F.col("idx").cast("long")
    )


def proximal_gradient(gradient: DataFrame, params: DataFrame, reference: DataFrame, mu: float) -> DataFrame:
    """Add mu (w - w_global) once per batch: the gradient of the proximal loss term."""
    local = params.select(CLIENT, "idx", F.col("value").alias("_local"))
    shared = reference.select(CLIENT, "idx", F.col("value").alias("_shared"))
    pull = F.lit(mu) * F.col("batches") * (F.col("_local") - F.col("_shared"))
    return (
        gradient.join(local, [CLIENT, "idx"])
        .join(shared, [CLIENT, "idx"])
        .withColumn("gradient", F.col("gradient") + pull)
        .drop("_local", "_shared")
    )


def proximal_loss(params: DataFrame, reference: DataFrame, mu: float) -> DataFrame:
    """mu / 2 times the squared distance to the shared weights, per client."""
    shared = reference.select(CLIENT, "idx", F.col("value").alias("_shared"))
    gap = F.col("value") - F.col("_shared")
    return (
        params.join(shared, [CLIENT, "idx"])
        .groupBy(CLIENT)
        .agg((F.lit(mu / 2) * F.sum(gap * gap)).alias("proximal_loss"))
    )


def clip_gradient(gradient: DataFrame, max_norm: float) -> DataFrame:
    """Scale the gradient of a client down to `max_norm` where it is longer."""
    norms = gradient.groupBy(CLIENT).agg(
        F.sqrt(F.sum(F.col("gradient") * F.col("gradient"))).alias("_norm")
    )
    factor = F.when(F.col("_norm") > max_norm, F.lit(max_norm) / F.col("_norm")).otherwise(1.0)
    return (
        gradient.join(norms, CLIENT)
        .withColumn("gradient", F.col("gradient") * factor)
        .drop("_norm")
    )


def noise_scale(last_batch: Column, epsilon: float) -> Column:
    """Standard deviation of the Gaussian mechanism for the size of the last batch."""
    return F.sqrt(2 * F.log(1.25 * last_batch)) / epsilon


def privacy_spent(rows: DataFrame, config: FederatedParams) -> DataFrame:
    """What the noise leaves of each client's privacy after each round.

    A noisy epoch is one use of the Gaussian mechanism, of the configured epsilon and a delta of one over the size of
    the last batch. `epsilon` and `delta` add up over all epochs so far; `tight_epsilon` is that of the same delta as
    one epoch by concentrated privacy, whose cost rho = 1 / (2 sigma^2) adds up too. Without noise there are no rows."""
    per_client = rows.groupBy(CLIENT).agg(F.max("last_batch").alias("last_batch"))
    rounds = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(config.rounds - 1).cast("long"))).alias("round")
    steps = (F.col("round") + 1) * config.epochs
    sigma, delta = noise_scale(F.col("last_batch"), config.epsilon), 1 / F.col("last_batch")
    rho = steps / (2 * sigma * sigma)
    return per_client.where(F.lit(config.noise)).select("*", rounds).select(
        "round", CLIENT, steps.alias("steps"), (config.epsilon * steps).alias("epsilon"),
        F.least(F.lit(1.0), delta * steps).alias("delta"), (rho + 2 * F.sqrt(rho * F.log(1 / delta))).alias("tight_epsilon"),
    )


def with_secret_seed(config: FederatedParams) -> FederatedParams:
    return config if config.seed is not None else replace(config, seed=secrets.randbits(63))


def _uniform(*parts: Column) -> Column:
    """Uniform in (0, 1] from the leading digits of a hash, the same on every retry of a task."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 1) / F.lit(_SHIFT)


def gaussian_noise(params: DataFrame, sigma: Column, seed: int | None, step: int = 0) -> DataFrame:
    """Add independent normal noise to every weight of every client.

    Drawn from the seed, the step and the row's key (Box-Muller), so a
    recomputed task draws the same numbers. The seed must stay secret.
    """
    if seed is None:
        raise ValueError("noise needs a seed; `with_secret_seed` draws one")
    key = [F.lit(seed), F.lit(step), F.col(CLIENT), F.col("idx")]
    radius = F.sqrt(-2 * F.log(_uniform(*key, F.lit("radius"))))
    angle = 2 * F.pi() * _uniform(*key, F.lit("angle"))
    return params.withColumn("value", F.col("value") + sigma * radius * F.cos(angle))


def local_epoch(rows: DataFrame, params: DataFrame, reference: DataFrame, config: FederatedParams,
                columns: Sequence[str] = FLAT_FEATURES, step: int = 0) -> DataFrame:
    """One update of every client's weights: (client_id, idx, value, n) in and out."""
    gradient = epoch_gradient(rows, params, columns, config.mode)
    if config.mode == "textbook":
        gradient = proximal_gradient(gradient, params, reference, config.mu)
        gradient = clip_gradient(gradient, config.max_grad_norm)
    updated = (
        params.select(CLIENT, "idx", "value")
        .join(gradient, [CLIENT, "idx"])
        .withColumn("value", F.col("value") - config.learning_rate * F.col("gradient"))
    )
    if config.noise:
        sigma = noise_scale(F.col("last_batch"), config.epsilon)
        updated = gaussian_noise(updated, sigma, config.seed, step)
    return updated.select(CLIENT, "idx", "value", "n")


def fed_avg(params: DataFrame) -> DataFrame:
    """Average of the clients' weights by their number of rows."""
    return params.groupBy("idx").agg(
        (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("value")
    )


@dataclass(frozen=True)
class FederatedModel:
    """Shared weights after the last round, all rounds as a table (round, idx, value), and the privacy spent by then."""

    weights: tuple[float, ...]
    rounds: DataFrame
    privacy: DataFrame


def _to_clients(clients: DataFrame, shared: DataFrame) -> DataFrame:
    """Give every client the shared weights, by index."""
    return clients.select(CLIENT, "idx", "n").join(shared, "idx").select(CLIENT, "idx", "value", "n")


def train(rows: DataFrame, config: FederatedParams, workspace: Workspace,
          columns: Sequence[str] = FLAT_FEATURES) -> FederatedModel:
    """Rounds of local epochs and weighted averaging over z-scored training rows."""
    config = with_secret_seed(config)
    weighted = workspace.durable(batch_weights(rows, config.batch_size), "train-rows")
    start = workspace.durable(zero_params(weighted, columns), "params-start")
    shared = None
    for number in range(config.rounds):
        base = start if shared is None else _to_clients(start, shared)
        current = base
        for epoch in range(config.epochs):
            step = number * config.epochs + epoch
            current = workspace.durable(
                local_epoch(weighted, current, base, config, columns, step),
                f"params-{number}-{epoch}",
            )
        shared = workspace.durable(fed_avg(current), f"shared/round={number}")
    history = (rows.sparkSession.read.schema("idx long, value double, round long")
               .parquet(workspace.child("shared")).select("round", "idx", "value"))
    final = tuple(r["value"] for r in shared.orderBy("idx").collect())  # features + 1 numbers
    return FederatedModel(final, history, privacy_spent(weighted, config))


# ------------------------------------------------------- scoring, evaluation


def score(frame: DataFrame, weights: Sequence[float], columns: Sequence[str] = FLAT_FEATURES) -> DataFrame:
    """Adds `score` to z-scored rows; the shared weights are literals of the plan."""
    literal = [F.lit(float(w)) for w in weights]
    return frame.withColumn("score", _sigmoid(_logit(columns, literal)))


def evaluate(scored: DataFrame, second_sigmoid: bool = False, threshold: float = 0.5) -> DataFrame:
    """Loss, rows, average precision and accuracy (in percent) per client.

    With `second_sigmoid` (parity) the accuracy takes the position of the largest
    of one output as the prediction.
    """
    right = metrics.accuracy(scored, LABEL, "score", threshold, [CLIENT], single_column_argmax=second_sigmoid)
    loss = metrics.bce_with_logits(scored, LABEL, "score", [CLIENT], second_sigmoid)
    rows = scored.groupBy(CLIENT).agg(F.count(F.lit(1)).alias("n"))
    ranked = metrics.average_precision(scored, LABEL, "score", [CLIENT])
    return loss.join(rows, CLIENT).join(ranked, CLIENT).join(right, CLIENT)


def overall(evaluation: DataFrame, metric: str = "bce_loss") -> DataFrame:
    """One metric over all clients, weighted by their rows."""
    return metrics.weighted_average(evaluation, metric)


def outcome_precision(scored: DataFrame, states: DataFrame, from_day: int = 50) -> DataFrame:
    """Average precision per client against what happened from `from_day` on (unknown: not ill)."""
    truth = true_labels(states, from_day, (CLIENT,)).select(CLIENT, "pid", "true_label")
    judged = scored.select(CLIENT, "pid", "score").join(truth, [CLIENT, "pid"], "left")
    return metrics.average_precision(
        judged.fillna(0, ["true_label"]), "true_label", "score", [CLIENT]
    )


def save_rounds(model: FederatedModel, path: str) -> None:
    model.rounds.write.mode("overwrite").parquet(f"{path}/rounds")
    model.privacy.write.mode("overwrite").parquet(f"{path}/privacy")


def load_rounds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("round long, idx long, value double").parquet(f"{path}/rounds")


def save_scaler(frame: DataFrame, path: str, columns: Sequence[str] = FLAT_FEATURES) -> None:
    """Statistics of the training rows of every client, next to the rounds."""
    group_statistics(frame, columns, [CLIENT]).write.mode("overwrite").parquet(f"{path}/scaler")


def load_weights(spark: SparkSession, path: str) -> tuple[float, ...]:
    """Shared weights of the last saved round."""
    rounds = load_rounds(spark, path)
    last = rounds.join(rounds.agg(F.max("round").alias("round")), "round", "left_semi")
    return tuple(r["value"] for r in last.orderBy("idx").collect())  # features + 1 numbers


def fit_clients(spark: SparkSession, tables: Mapping[str, DataFrame], prepared_path: str,
                model_path: str, config: FederatedParams | None = None,
                params: RunParams = FLAT_TRAIN_PARAMS) -> tuple[FederatedModel, DataFrame]:
    """Train over all clients; returns the model and the evaluation on the held-out rows."""
    config = config or FederatedParams()
    workspace = Workspace(spark, "federated-fit")
    frame = prepared_frame(spark, tables, params, prepared_path)
    save_scaler(frame, model_path)
    stats = spark.read.parquet(f"{model_path}/scaler")
    rows = workspace.durable(split(standardised(frame, workspace, "scaler", stats=stats)), "split-rows")
    model = train(rows.where(F.col("is_test") == 0), config, workspace)
    save_rounds(model, model_path)
    held_out = score(rows.where(F.col("is_test") == 1), model.weights)
    return model, evaluate(held_out, config.mode == "parity", config.threshold)


def predict_clients(spark: SparkSession, tables: Mapping[str, DataFrame], prepared_path: str,
                    model_path: str, destination: str, params: RunParams = FLAT_TEST_PARAMS,
                    own_scaling: bool = False) -> DataFrame:
    """Score every person of every client and write one folder of predictions per client.

    Features are scaled as in training, by the statistics saved with the model.
    own_scaling=True (parity) scales each client's test rows by themselves.
    """
    workspace = Workspace(spark, "federated-predict")
    frame = prepared_frame(spark, tables, params, prepared_path)
    stats = None if own_scaling else spark.read.parquet(f"{model_path}/scaler")
    scaled = standardised(frame, workspace, "scaler", stats=stats)
    scored = score(scaled, load_weights(spark, model_path)).select(CLIENT, "pid", "score")
    io.write_predictions(scored, destination, CLIENT)
    return scored
