"""Coverage, rejects and data-quality reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import time as ft
from .staging import stored

# Outcomes of fetching one day, best first.
OUTCOMES = ("fetched", "skipped", "failed")


def missing_days(expected: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """Expected (source, date) rows that have no data."""
    return expected.join(present.select(*on).distinct(), list(on), "left_anti")


def coverage(expected: DataFrame, attempts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Status per expected day: fetched, skipped, failed or missing.

    ``attempts`` has ``status`` and optionally ``reason``; a day with several
    attempts counts as fetched if any attempt was, then skipped, then failed.
    """
    best = attempts.groupBy(*on).agg(
        *[F.bool_or(F.col("status") == status).alias(f"_{status}") for status in OUTCOMES]
    )
    status = F.lit("missing")
    for outcome in reversed(OUTCOMES):
        status = F.when(F.col(f"_{outcome}"), outcome).otherwise(status)
    return expected.join(best, list(on), "left").select(*expected.columns, status.alias("status"))


def axis_misses(slots: DataFrame, day: str, interval: str, timezone: str) -> DataFrame:
    """Slot rows whose number does not exist on their local day."""
    return slots.filter(~ft.slot_exists(day, interval, F.col(timezone)))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def range_violations(
    df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]]
) -> DataFrame:
    """Per column: rows that are NULL, below the lower or above the upper bound."""
    one = F.lit(1)
    stats = []
    for column, (low, high) in bounds.items():
        below = F.lit(False) if low is None else F.col(column) < low
        above = F.lit(False) if high is None else F.col(column) > high
        stats.append(
            F.struct(
                F.lit(column).alias("column"),
                F.count(F.when(F.col(column).isNull(), one)).alias("nulls"),
                F.count(F.when(below, one)).alias("below"),
                F.count(F.when(above, one)).alias("above"),
            )
        )
    return df.agg(F.array(*stats).alias("_stats")).select(F.inline("_stats"))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count, NULLs, extremes and quartiles per numeric column, all exact.

    A quartile is the least value that at least that share of the non-NULL values
    do not exceed.
    """
    stats = []
    for column in columns:
        stats.append(
            F.struct(
                F.lit(column).alias("column"),
                F.count("*").alias("rows"),
                F.count(F.when(F.col(column).isNull(), 1)).alias("nulls"),
                F.min(column).cast("double").alias("low"),
                F.max(column).cast("double").alias("high"),
            )
        )
    plain = df.agg(F.array(*stats).alias("_stats")).select(F.inline("_stats"))
    found = quantiles(df, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return plain.join(found, "column", "left").select(
        "column", "rows", "nulls", "low", "q1", "median", "q3", "high"
    )


def quantiles(df: DataFrame, columns: Sequence[str], shares: Mapping[str, float]) -> DataFrame:
    """Exact quantiles: ``column`` and one column per share.

    Equal values are counted first; the distinct ones are sorted into ranges of
    about equal size and stored, so that the ranges stay what they are.  The counts of the
    ranges tell which range holds a rank, and running counts inside a range which
    value, so no task sees more than one range.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    counts = (
        df.select(F.inline(pairs)).filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count("*").alias("n"))
        .repartitionByRange("column", "value").withColumn("_range", F.spark_partition_id())
    )
    counts = stored(counts, "quantiles")
    earlier = Window.partitionBy("column").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("column")
    ranges = counts.groupBy("column", "_range").agg(F.sum("n").alias("_size")).select(
        "column", "_range",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_begin"),
        F.sum("_size").over(everything).alias("_total"),
    )
    upto = Window.partitionBy("column", "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_inside", F.sum("n").over(upto)).join(ranges, ["column", "_range"])
    reached = F.col("_begin") + F.col("_inside")
    return ranked.groupBy("column").agg(
        *[F.min(F.when(reached >= F.ceil(F.lit(q) * F.col("_total")), F.col("value"))).alias(name) for name, q in shares.items()]
    )


def slots_per_day(slots: DataFrame, day: str, timezone: str, keys: Sequence[str]) -> DataFrame:
    """Distinct stored slots per day next to the number the day really has."""
    return (
        slots.groupBy(*keys, day, timezone)
        .agg(F.count("*").alias("stored"))
        .withColumn("expected", ft.slots_in_day(day, F.col(timezone)))
        .withColumn("complete", F.col("stored") == F.col("expected"))
    )
