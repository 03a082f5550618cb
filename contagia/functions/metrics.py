"""Metrics over scored tables, as aggregations, overall or per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contagia.functions.prefix import ROWS_PER_RANGE, running_sums
from contagia.sources.workspace import Workspace

_CLIP = 1e-15  # fixed value: smallest probability in the logarithms


def _aggregate(df: DataFrame, groups: Sequence[str], *columns: Column) -> DataFrame:
    return df.groupBy(*groups).agg(*columns) if groups else df.agg(*columns)


def average_precision(scored: DataFrame, label: str, score: str, groups: Sequence[str] = (),
                      rows_per_range: int = ROWS_PER_RANGE, workspace: Workspace | None = None) -> DataFrame:
    """Step-wise average precision; rows with equal scores enter together.

    Rows are first summed per score. The counts above each score are running
    sums over ranges of scores, whose number follows the number of scores.
    """
    groups = list(groups)
    steps = scored.groupBy(*groups, F.col(score).alias("score")).agg(
        F.sum(label).alias("hits"), F.count(F.lit(1)).alias("rows")
    )
    curve = running_sums(steps, groups, [F.desc("score")], ["hits", "rows"], rows_per_range, workspace)
    step = F.try_divide(F.col("hits").cast("double"), F.col("total_hits")) * F.col("running_hits") / F.col("running_rows")
    return _aggregate(
        curve, groups, F.coalesce(F.sum(step), F.lit(0.0)).alias("average_precision")
    )


def precision_recall(scored: DataFrame, label: str, score: str, threshold: float = 0.5,
                     groups: Sequence[str] = ()) -> DataFrame:
    """Precision and recall of score >= threshold; 0 where undefined."""
    predicted = F.when(F.col(score) >= threshold, 1).otherwise(0)
    hits = F.sum(F.when((F.col(score) >= threshold) & (F.col(label) == 1), 1).otherwise(0)).cast("double")
    zero = F.lit(0.0)
    return _aggregate(
        scored,
        groups,
        F.coalesce(F.try_divide(hits, F.sum(predicted)), zero).alias("precision"),
        F.coalesce(F.try_divide(hits, F.sum(F.col(label))), zero).alias("recall"),
    )


def log_loss(scored: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    p = F.greatest(F.least(F.col(score), F.lit(1 - _CLIP)), F.lit(_CLIP))
    y = F.col(label)
    return _aggregate(
        scored, groups, F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss")
    )


def mean_squared_error(scored: DataFrame, label: str, prediction: str,
                       groups: Sequence[str] = ()) -> DataFrame:
    gap = F.col(label) - F.col(prediction)
    return _aggregate(scored, groups, F.avg(gap * gap).alias("mse"))


def accuracy(scored: DataFrame, label: str, score: str, threshold: float = 0.5,
             groups: Sequence[str] = (), single_column_argmax: bool = False) -> DataFrame:
    """Percentage of right predictions.

    single_column_argmax=True takes the position of the largest of one
    output, which is always 0, as the prediction.
    """
    predicted = F.lit(0) if single_column_argmax else F.when(F.col(score) >= threshold, 1).otherwise(0)
    right = F.sum(F.when(predicted == F.col(label), 1).otherwise(0))
    return _aggregate(scored, groups, (100 * right / F.count(F.lit(1))).alias("accuracy"))


def bce_with_logits(scored: DataFrame, label: str, score: str, groups: Sequence[str] = (),
                    second_sigmoid: bool = False) -> DataFrame:
    """Binary cross-entropy on logits, in the form that cannot overflow.

    `score` is a probability. Its logit is the input by default;
    second_sigmoid=True feeds the probability itself in as if it were a logit.
    """
    p = F.col(score)
    inside = F.greatest(F.least(p, F.lit(1 - _CLIP)), F.lit(_CLIP))
    z = p if second_sigmoid else F.log(inside / (1 - inside))
    y = F.col(label)
    loss = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
    return _aggregate(scored, groups, F.avg(loss).alias("bce_loss"))


def weighted_average(metrics: DataFrame, metric: str, weight: str = "n",
                     groups: Sequence[str] = ()) -> DataFrame:
    """Average of per-client metrics, weighted by the number of examples."""
    total = F.sum(F.col(metric) * F.col(weight)) / F.sum(weight)
    return _aggregate(metrics, groups, total.alias(metric))
