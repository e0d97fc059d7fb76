"""Contiguous runs of rows with an equal value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_runs(df: DataFrame, group: Sequence[str], order: str, value: str) -> DataFrame:
    """Add ``run_id``: 1, 2, ... in ``order``; a new run starts where ``value`` changes.

    Consecutive means adjacent rows; a gap in time does not end a run.  Both
    windows and any later grouping by (group, run_id) share one shuffle.
    ``group`` is meant to be a delivery day, so it holds at most 100 rows.
    """
    walk = Window.partitionBy(*group).orderBy(order)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(walk)) | (F.row_number().over(walk) == 1)
    return df.withColumn("_starts", changed.cast("int")).withColumn(
        "run_id", F.sum("_starts").over(walk).cast("int")
    ).drop("_starts")


def collapse_runs(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    value: str,
    aggregates: Sequence[Column],
) -> DataFrame:
    """One row per run with its value and ``aggregates``."""
    return (
        number_runs(df, group, order, value)
        .groupBy(*group, "run_id")
        .agg(F.first(value).alias(value), *aggregates)
    )
