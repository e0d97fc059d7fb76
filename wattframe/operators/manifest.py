"""Which days of a source are there, as bitmaps that are merged run by run.

A bitmap has a bit for each of 32,768 days, so a source, some ninety years long, is one row.  A run adds the days it
has seen by OR; whether a day is missing then costs a look at a few rows instead of a listing of all slices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import OUTCOMES
from .store import merge_upsert, read_table, table_exists


def _number(day: str) -> Column:
    return F.unix_date(F.col(day)).cast("long")


def day_bitmaps(days: DataFrame, by: Sequence[str], day: str = "date") -> DataFrame:
    """``by``, ``bucket`` and ``days``; NULL days are left out.  Bits are combined before the shuffle."""
    known = days.filter(F.col(day).isNotNull())
    return known.groupBy(*by, F.bitmap_bucket_number(_number(day)).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(_number(day))).alias("days")
    )


def merged_bitmaps(bitmaps: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per ``by`` and bucket, with the days of all its rows."""
    return bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("days").alias("days"))


def holds(bitmap: str, day: str) -> Column:
    """Whether the bit of ``day`` is set; False without a bitmap."""
    place = F.bitmap_bit_position(_number(day))
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.when(F.col(bitmap).isNotNull(), F.getbit(byte, (place % 8).cast("int")) == 1)
    return F.coalesce(bit, F.lit(False))


def record_days(spark: SparkSession, path: str, days: DataFrame, by: Sequence[str], day: str = "date") -> int:
    """Add days to the stored manifest; returns how many bitmaps changed or came in.  ``by`` must not be NULL."""
    new = day_bitmaps(days, by, day)
    if table_exists(spark, path):
        keys = [*by, "bucket"]
        stored = read_table(spark, path, schema=new.schema)
        new = merged_bitmaps(stored.join(new.select(*keys), keys, "left_semi").unionByName(new), by)
        new = new.join(stored, [*keys, "days"], "left_anti")
    return merge_upsert(spark, new, path, [*by, "bucket"])


def days_held(bitmaps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Number of days per source, without listing them."""
    return bitmaps.groupBy(*by).agg(F.sum(F.bitmap_count("days")).alias("days"))


def _looked_up(expected: DataFrame, bitmaps: DataFrame, by: Sequence[str], day: str) -> DataFrame:
    placed = expected.withColumn("bucket", F.bitmap_bucket_number(_number(day)))
    return placed.join(bitmaps, [*by, "bucket"], "left")


def missing_in_manifest(expected: DataFrame, bitmaps: DataFrame, by: Sequence[str], day: str = "date") -> DataFrame:
    """``quality.missing_days`` by bitmaps."""
    return _looked_up(expected, bitmaps, by, day).filter(~holds("days", day)).select(*expected.columns)


def coverage_of_manifest(
    expected: DataFrame, bitmaps: DataFrame, by: Sequence[str], day: str = "date", status: str = "status"
) -> DataFrame:
    """``quality.coverage`` by bitmaps recorded by source and ``status``."""
    columns = {outcome: f"_{outcome}" for outcome in OUTCOMES}
    wide = bitmaps.groupBy(*by, "bucket").agg(
        *[F.bitmap_or_agg(F.when(F.col(status) == outcome, F.col("days"))).alias(c) for outcome, c in columns.items()]
    )
    found: Mapping[str, Column] = {outcome: holds(c, day) for outcome, c in columns.items()}
    best = F.lit("missing")
    for outcome in reversed(OUTCOMES):
        best = F.when(found[outcome], outcome).otherwise(best)
    return _looked_up(expected, wide, by, day).select(*expected.columns, best.alias("status"))
