"""Revisions as intervals of validity, and states as they were known at an instant.

A stored revision is current from its ingest until the next one of its key; ``valid_to`` is open for the last.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fill import asof_join
from .latest import latest_per_key


def validity(
    df: DataFrame, keys: Sequence[str], order: str = "ingested_at", tiebreak: Sequence[str] = (), chunk: str = "month",
) -> DataFrame:
    """Rows with ``valid_from`` and ``valid_to``, one per key and instant; of several the greatest by ``tiebreak``.

    A key is cut into time chunks of a ``date_trunc`` unit; where a chunk's last revision ends comes from a summary
    with one row per (key, chunk), so no task holds a whole key.
    """
    cells = latest_per_key(df, [*keys, order], order, tiebreak).withColumn("_chunk", F.date_trunc(chunk, F.col(order)))
    cell = [*keys, "_chunk"]
    inside = F.lead(order).over(Window.partitionBy(*cell).orderBy(order))
    begins = cells.groupBy(*cell).agg(F.min(order).alias("_next"))
    after = Window.partitionBy(*keys).orderBy("_chunk")
    nexts = begins.withColumn("_next", F.lead("_next").over(after)).withColumnsRenamed({c: f"_k_{c}" for c in cell})
    joined = cells.withColumn("_inside", inside).join(
        nexts, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in cell], "left"
    )
    return joined.select(*df.columns, F.col(order).alias("valid_from"), F.coalesce("_inside", "_next").alias("valid_to"))


def state_at(intervals: DataFrame, at: Column | datetime) -> DataFrame:
    """The rows of ``validity`` that were current at an instant."""
    at = at if isinstance(at, Column) else F.lit(at)
    known = (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))
    return intervals.filter(known).drop("valid_from", "valid_to")


def known_when(
    facts: DataFrame, revisions: DataFrame, by: Sequence[str], at: str, payload: Sequence[str], order: str = "ingested_at",
) -> DataFrame:
    """Attach to each fact the ``payload`` of its key's revision that was current at the fact's instant ``at``.

    Both sides are walked once along the instants (``fill.asof_join``), so the revisions of a key are not paired with
    its facts.  A fact older than the first revision gets NULL.
    """
    known = revisions.select(*by, F.col(order).alias(at), *payload)
    return asof_join(facts, known, by, at, payload)
