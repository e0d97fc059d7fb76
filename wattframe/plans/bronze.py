"""Appending observations to a Bronze table, the way its definition says."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.bucketed import append_to_buckets
from ..operators.store import append_new_observations
from ..schemas import Table


def append(rows: DataFrame, table: Table, base: str, prune: str, compare: str = "any") -> int:
    """Append what ``table`` does not hold yet; ``rows`` conform to it and may be read twice."""
    spark, path = rows.sparkSession, table.path(base)
    if table.buckets:
        return append_to_buckets(
            spark, rows, path, table.keys, table.values, table.buckets, table.month_of, compare
        )
    return append_new_observations(
        spark, rows, path, table.keys, table.values, table.partitions, compare=compare, prune=prune,
        month_of=table.month_of,
    )
