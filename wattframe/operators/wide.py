"""Long to wide and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wide_mix(
    df: DataFrame,
    keys: Sequence[str],
    name: str,
    value: str,
    columns: Mapping[str, str],
    totals: Mapping[str, Column],
    labels: Sequence[str] = (),
    other: str = "other_discovered_mw",
) -> DataFrame:
    """Pivot listed names into ``columns`` and sum the roll-ups, in one aggregation.

    ``columns`` maps a name to its output column.  A name outside the list goes
    to ``other``; a NULL name only enters ``totals``.  Cells without a row are
    0.0.  ``totals`` maps an output column to the condition that selects its
    rows.  A constant list keeps the schema stable and needs no discovery pass.
    """
    amount, label = F.col(value), F.col(name)
    cells = [
        F.coalesce(F.max(F.when(label == listed, amount)), F.lit(0.0)).alias(column)
        for listed, column in columns.items()
    ]
    rest = F.sum(F.when(~label.isin(list(columns)), amount))
    sums = [
        F.sum(F.when(condition, amount).otherwise(0.0)).alias(column)
        for column, condition in totals.items()
    ]
    return df.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in labels],
        *cells,
        F.coalesce(rest, F.lit(0.0)).alias(other),
        F.sum(amount).alias("total_mw"),
        *sums,
    )


def share_pct(part: str, whole: str) -> Column:
    """Percentage; NULL unless the whole is positive."""
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole) * 100.0)


def melt(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str
) -> DataFrame:
    """Wide to long; NaN becomes NULL."""
    long = df.unpivot(list(ids), list(values), name, value)
    return long.withColumn(value, F.when(~F.isnan(value), F.col(value)))


def as_map(columns: Sequence[str]) -> Column:
    """Map from column name to value."""
    pairs = [part for c in columns for part in (F.lit(c), F.col(c))]
    return F.create_map(*pairs)
