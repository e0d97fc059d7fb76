"""Foreign keys and stable surrogate ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stored


def resolve(facts: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in ``dim``, with the dimension's columns added."""
    return facts.join(dim, list(on), "inner")


def unresolved(facts: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is missing from ``dim``, a NULL key included."""
    return facts.join(dim.select(*on), list(on), "left_anti")


def unresolved_counts(facts: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Dropped rows per unknown key.

    Counts per key come first, so the join sees one row per distinct key.
    """
    counts = facts.groupBy(*on).agg(F.count("*").alias("dropped_rows"))
    return unresolved(counts, dim, on)


def number_in_order(names: DataFrame, column: str) -> DataFrame:
    """Add ``position`` 1, 2, ... in ascending order of distinct values; NULLs are left out.

    The names are sorted into ranges of about equal size and stored, so that the
    ranges stay what they are.  A range's count tells where the next one begins;
    one task numbers one range, and one adds up the counts of the ranges.
    """
    ranges = names.filter(F.col(column).isNotNull()).repartitionByRange(column)
    ranges = stored(ranges.withColumn("_range", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = ranges.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin")
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return ranges.withColumn("_inside", inside).join(begins, "_range").select(
        *names.columns, (F.col("_begin") + F.col("_inside")).cast("int").alias("position")
    )


def assign_stable_ids(
    fixed: DataFrame, seen: DataFrame, assigned: DataFrame, name: str, id_column: str
) -> DataFrame:
    """Ids for every seen name that ``fixed`` does not list.

    A name in ``assigned`` keeps its id for ever.  A new one gets the next id
    above all ids ever given out, in name order.
    """
    discovered = (
        seen.select(name).filter(F.col(name).isNotNull()).distinct()
        .join(fixed.select(name), name, "left_anti")
    )
    kept = discovered.join(assigned.select(name, id_column), name)
    top = (
        fixed.select(id_column).unionByName(assigned.select(id_column))
        .agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_top"))
    )
    fresh = number_in_order(discovered.join(assigned.select(name), name, "left_anti"), name)
    numbered = fresh.select(
        name, (top.scalar() + F.col("position")).cast("int").alias(id_column)
    )
    return kept.unionByName(numbered)
