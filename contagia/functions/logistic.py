"""Penalised logistic regression by Newton steps over aggregated moments.

One step needs the gradient and the weighted cross products of the features:
(features + 1) squared numbers, however many rows there are. Every task sums
them over its rows, tasks are combined by position, and only the totals reach
the driver, where one small system is solved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LogisticFit:
    intercept: float
    weights: tuple[float, ...]
    loss: float
    passes: int
    converged: bool


def moments(rows: DataFrame, columns: Sequence[str], label: str, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log loss, its gradient and second derivatives (all sums over the rows) at `beta`, intercept first."""
    width, point = len(columns) + 1, np.asarray(beta, float)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + width + width * width)
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *(c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])])
            y = batch.column(0).to_numpy(zero_copy_only=False)
            z = x @ point
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            total[0] += np.sum(np.logaddexp(0, z) - y * z)
            total[1:1 + width] += x.T @ (p - y)
            total[1 + width:] += ((x * (p * (1 - p))[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["total"])

    wanted = rows.where(F.col(label).isNotNull()).select(*(F.col(c).cast("double") for c in (label, *columns)))
    sums = wanted.mapInArrow(partial, "total array<double>").select(F.posexplode("total")).groupBy("pos").agg(F.sum("col").alias("v"))
    flat = np.zeros(1 + width + width * width)
    for row in sums.collect():  # (features + 1) squared and some numbers, whatever the number of rows
        flat[row["pos"]] = row["v"]
    return float(flat[0]), flat[1:1 + width], flat[1 + width:].reshape(width, width)


def fit_logistic(rows: DataFrame, columns: Sequence[str], label: str, penalty: float = 1.0, max_passes: int = 30,
                 tolerance: float = 1e-9) -> LogisticFit:
    """Least sum of log losses plus penalty / 2 times the squared weights; the intercept is free.

    `rows` is read once per step, so pass a stored table; null labels are left out. A step that does not lower the
    loss is halved. Without rows all weights are zero."""
    ridge = penalty * np.eye(len(columns) + 1)
    ridge[0, 0] = 0.0

    def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, slope, curve = moments(rows, columns, label, beta)
        return loss + 0.5 * float(beta @ ridge @ beta), slope + ridge @ beta, curve + ridge

    beta = np.zeros(len(columns) + 1)
    loss, slope, curve = at(beta)
    passes, done = 1, False
    while passes < max_passes and not done:
        step = np.linalg.lstsq(curve, slope, rcond=None)[0]
        while True:
            tried = beta - step
            found = at(tried)
            passes += 1
            if found[0] <= loss + 1e-9 * abs(loss) or passes >= max_passes:
                break
            step = step / 2
        done = bool(np.max(np.abs(step)) <= tolerance * (1 + np.max(np.abs(tried))))
        if found[0] <= loss + 1e-9 * abs(loss):
            beta, (loss, slope, curve) = tried, found
    return LogisticFit(float(beta[0]), tuple(map(float, beta[1:])), loss, passes, done)
