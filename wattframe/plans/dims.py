"""Dimension tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import time as ft
from ..operators.axis import date_spine, settlement_axis
from ..operators.resolve import assign_stable_ids
from ..registry import locations_frame, market_timezones, small_frame


def date_bounds(spark: SparkSession, start: date, end: date) -> DataFrame:
    return small_frame(spark, [(start, end)], "start date, end date")


def dim_date(days: DataFrame, date_column: str = "date") -> DataFrame:
    """Calendar attributes for every row of ``days``."""
    day = F.col(date_column)
    return days.select(
        ft.date_id(day).alias("date_id"),
        day.alias("full_date"),
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.dayofmonth(day).alias("day_of_month"),
        cal.weekday_number(day).alias("day_of_week"),
        F.weekofyear(day).alias("week_of_year"),
        F.quarter(day).alias("quarter"),
        (cal.weekday_number(day) <= 5).alias("is_weekday"),
        cal.is_public_holiday(day).alias("is_ro_holiday"),
        cal.season(day).alias("season"),
    )


def dim_datetime(markets: DataFrame, start: date, end: date) -> DataFrame:
    """Settlement axis of every zone in the registry for the dates [start, end]."""
    zones = market_timezones(markets).select(
        "timezone", F.lit(start).alias("start"), F.lit(end).alias("end")
    )
    return settlement_axis(date_spine(zones))


def dim_market(markets: DataFrame) -> DataFrame:
    return markets.select(
        "market_id", "market_name", "bidding_zone", "timezone", "currency",
        "reporting_currency", "peak_start_hour", "peak_end_hour",
    )


def dim_location(markets: DataFrame) -> DataFrame:
    return locations_frame(markets)


def dim_production_type(listed: DataFrame, seen: DataFrame, assigned: DataFrame) -> DataFrame:
    """Published types plus the discovered ones, whose ids never change.

    ``listed`` is the published list, ``seen`` has ``production_type`` and
    ``assigned`` is the stored dimension (or an empty frame).
    """
    found = assign_stable_ids(
        listed,
        seen.select(F.col("production_type").alias("production_type_name")),
        assigned,
        "production_type_name",
        "production_type_id",
    )
    no = F.lit(False)
    discovered = found.select(
        "production_type_id", "production_type_name", F.lit("Other").alias("energy_category"),
        no.alias("is_renewable"), no.alias("is_variable"), no.alias("is_dispatchable"),
    )
    return listed.unionByName(discovered)
