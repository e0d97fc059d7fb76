"""Date ranges and the settlement-slot axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import time as ft


def date_spine(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Every date in [start, end] for each row of ``bounds``; other columns ride along."""
    days = F.when(F.col(start) <= F.col(end), F.sequence(F.col(start), F.col(end)))
    rest = [c for c in bounds.columns if c not in (start, end)]
    return bounds.select(*rest, F.explode(days).alias("date"))


def settlement_axis(days: DataFrame, date: str = "date", timezone: str = "timezone") -> DataFrame:
    """All settlement slots of each (date, timezone) row.

    Steps a quarter hour at a time in UTC from one local midnight to the next;
    92, 96 or 100 slots fall out.  The slot number is the position in the step
    list, so no window function and no shuffle is involved.
    """
    tz = F.col(timezone)
    begin = ft.local_midnight_utc(date, tz)
    last = ft.slot_start_utc(date, ft.slots_in_day(date, tz), tz)
    step = F.expr(f"INTERVAL {ft.SLOT_MINUTES} MINUTES")
    slots = days.select(
        tz.alias("timezone"),
        ft.date_id(date).alias("date_id"),
        F.posexplode(F.sequence(begin, last, step)).alias("_pos", "timestamp_utc"),
    ).withColumn("_local", ft.local_time("timestamp_utc", F.col("timezone")))
    return slots.select(
        "timezone",
        "timestamp_utc",
        "date_id",
        (F.col("_pos") + 1).alias("interval_of_day"),
        ft.clock_position("_local").alias("local_time_id"),
        F.hour("_local").alias("local_hour"),
        F.floor(F.minute("_local") / ft.SLOT_MINUTES).cast("int").alias("quarter_of_hour"),
        ft.clock_label("_local").alias("time_label"),
        ft.utc_offset_minutes("timestamp_utc", F.col("timezone")).alias("utc_offset_minutes"),
        ft.is_dst("timestamp_utc", F.col("timezone")).alias("is_dst"),
        ft.is_repeated("timestamp_utc", F.col("timezone")).alias("is_repeated_hour"),
        (F.minute("_local") == 0).alias("is_hour_start"),
    )


def peak_slot_range(
    axis: DataFrame, peak_start: int = 8, peak_end: int = 20
) -> DataFrame:
    """First and last slot number of the peak block per (timezone, date_id)."""
    in_peak = (F.col("local_hour") >= peak_start) & (F.col("local_hour") < peak_end)
    slot = F.when(in_peak, F.col("interval_of_day"))
    return axis.groupBy("timezone", "date_id").agg(
        F.min(slot).alias("first_peak"), F.max(slot).alias("last_peak")
    )


def join_axis(slots: DataFrame, axis: DataFrame, timezone: str = "timezone") -> DataFrame:
    """Resolve (timezone, date_id, interval_of_day) through a stored axis; misses drop out.

    The stored axis grows by about 35,000 rows per zone and year, so the choice
    of broadcast or shuffle is left to the optimizer's size check.
    ``functions.time.slot_start_utc`` gives the same instant without a join.
    """
    lookup = axis.select(
        F.col("timezone").alias(timezone), "date_id", "interval_of_day",
        "timestamp_utc", "local_time_id",
    )
    return slots.join(lookup, [timezone, "date_id", "interval_of_day"], "inner")
