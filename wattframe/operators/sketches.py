"""Profiles that can be merged: per group and column counts, extremes and a quantile sketch.

``quality.profile`` is exact and reads all rows each time.  Here a day's rows are read once; a range of days is a
merge of some kilobytes each.  A sketch is KLL (Karnin, Lang, Liberty, 2016): its answers are random, and the rank of an
answer is off by more than ``rank_error(k)`` practically never, whatever the data, their order and the number of merges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_K = 1000
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def rank_error(k: int = DEFAULT_K) -> float:
    """Share of the values by which the rank of a sketch's answer can be off: twice what holds for 99 % of the answers."""
    return 2 * 2.446 / k**0.9433


def sketched(df: DataFrame, by: Sequence[str], columns: Sequence[str], k: int = DEFAULT_K) -> DataFrame:
    """``by``, ``column``, ``rows``, ``nulls``, ``low``, ``high`` and ``sketch`` (NULL without a value); NaN counts as NULL."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    values = df.select(*by, F.inline(pairs)).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    found = values.groupBy(*by, "column").agg(
        F.count("*").alias("rows"), F.count_if(F.col("value").isNull()).alias("nulls"),
        F.min("value").alias("low"), F.max("value").alias("high"), F.kll_sketch_agg_double("value", k).alias("sketch"),
    )
    return found.withColumn("sketch", F.when(F.col("rows") > F.col("nulls"), F.col("sketch")))


def merged_sketches(sketches: DataFrame, by: Sequence[str], k: int = DEFAULT_K) -> DataFrame:
    """The same for coarser groups, for instance days merged into a range."""
    found = sketches.groupBy(*by, "column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch", k).alias("sketch"),
    )
    return found.withColumn("sketch", F.when(F.col("rows") > F.col("nulls"), F.col("sketch")))


def approximate_profile(sketches: DataFrame, shares: Mapping[str, float] = QUARTILES) -> DataFrame:
    """The sketches' quantiles in place of the sketches; NULL for a group without a value."""
    known = F.col("sketch").isNotNull()
    return sketches.withColumns(
        {name: F.when(known, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))) for name, q in shares.items()}
    ).drop("sketch")


def within_error(
    df: DataFrame, profile: DataFrame, by: Sequence[str], columns: Sequence[str], shares: Mapping[str, float] = QUARTILES,
    k: int = DEFAULT_K,
) -> DataFrame:
    """Per group and column whether each quantile's true rank is within the bound; NULL without a value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    values = df.select(*by, F.inline(pairs)).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    asked = profile.select(*by, "column", *shares)
    ranks = values.join(asked, [*by, "column"]).groupBy(*by, "column").agg(
        F.count("*").alias("_n"),
        *[F.count_if(F.col("value") < F.col(name)).alias(f"_below_{name}") for name in shares],
        *[F.count_if(F.col("value") <= F.col(name)).alias(f"_upto_{name}") for name in shares],
    )
    off = rank_error(k)
    good = {
        f"{name}_within": (F.col(f"_below_{name}") <= (q + off) * F.col("_n")) & (F.col(f"_upto_{name}") >= (q - off) * F.col("_n"))
        for name, q in shares.items()
    }
    checked = ranks.select(*by, "column", *[c.alias(name) for name, c in good.items()])
    return profile.drop(*shares).join(checked, [*by, "column"], "left")
