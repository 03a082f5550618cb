"""Null fill and z-scores with the population standard deviation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contagia.functions.joins import spread_join


def z_name(column: str) -> str:
    return f"z_{column}"


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0))


def _statistics(columns: Sequence[str]) -> list[Column]:
    out = []
    for c in columns:
        out.append(F.avg(_filled(c)).alias(f"mean_{c}"))
        out.append(F.stddev_pop(_filled(c)).alias(f"std_{c}"))
    return out


@dataclass(frozen=True)
class Scaler:
    """Fitted means and standard deviations, one pair per column."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                z_name(c): (_filled(c) - F.lit(m)) / F.lit(s)
                for c, m, s in zip(self.columns, self.means, self.stds)
            }
        )

    def statement(self) -> str:
        """The same step as SQL, for a saveable ML pipeline stage."""
        terms = [
            f"(coalesce(cast({c} AS double), 0.0D) - ({m!r}D)) / {s!r}D AS {z_name(c)}"
            for c, m, s in zip(self.columns, self.means, self.stds)
        ]
        return f"SELECT *, {', '.join(terms)} FROM __THIS__"


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """One aggregation; a single row of 2 x columns numbers reaches the driver."""
    row = df.agg(*_statistics(columns)).first()
    means = tuple(float(row[f"mean_{c}"] or 0.0) for c in columns)
    stds = tuple(float(row[f"std_{c}"] or 0.0) or 1.0 for c in columns)
    return Scaler(tuple(columns), means, stds)


def group_statistics(df: DataFrame, columns: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Means and standard deviations per group, one row each."""
    return df.groupBy(*groups).agg(*_statistics(columns))


def apply_group_statistics(df: DataFrame, stats: DataFrame, columns: Sequence[str],
                           groups: Sequence[str], spread_by: Sequence[str] = ("pid",)) -> DataFrame:
    """z-scores by the statistics of the row's group.

    Pass `stats` as a stored table (see Workspace.durable): the planner then
    broadcasts it if and only if it is below the session's threshold. Above
    it, the rows of a large group are spread over tasks.
    """
    scaled = spread_join(df, stats, groups, spread_by).withColumns(
        {
            z_name(c): (_filled(c) - F.col(f"mean_{c}"))
            / F.when(F.col(f"std_{c}") == 0, 1.0).otherwise(F.col(f"std_{c}"))
            for c in columns
        }
    )
    return scaled.drop(*[f"mean_{c}" for c in columns], *[f"std_{c}" for c in columns])
