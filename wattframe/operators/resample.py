"""Coarser time grain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_by(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Mapping[str, Column],
    values: Sequence[str],
    labels: Sequence[str] = (),
    count: str | None = None,
) -> DataFrame:
    """Mean of ``values`` per key and time bucket; NULLs are left out of a mean.

    ``labels`` must be constant within a bucket (local date, clock position,
    applied rate); they are carried by ``max``, which also skips NULLs.  ``count``
    names a column with the number of rows.  All
    aggregates combine map-side, so a hot key does not concentrate.
    """
    ((name, expression),) = bucket.items()
    return (
        df.withColumn(name, expression)
        .groupBy(*keys, name)
        .agg(
            *[F.avg(c).alias(c) for c in values],
            *[F.max(c).alias(c) for c in labels],
            *([] if count is None else [F.count("*").alias(count)]),
        )
    )
