"""Derived tables that combine facts."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import time as ft
from ..operators.wide import share_pct

# Weather value and the weight that makes it a national signal.
SIGNALS = {
    "wind": ("wind_speed_ms", "wind_weight"),
    "solar": ("solar_irradiance_wm2", "solar_weight"),
    "demand": ("temperature_c", "demand_weight"),
}


def _weighted(value: str, weight: str) -> Column:
    """Weighted mean over the locations that have a value."""
    present = F.when(F.col(value).isNotNull(), F.col(weight))
    total = F.sum(present)
    return F.when(total != 0, F.sum(F.col(value) * F.col(weight)) / total)


def national_weather(
    fact_weather: DataFrame,
    locations: DataFrame,
    signals: Mapping[str, tuple[str, str]] = SIGNALS,
) -> DataFrame:
    """Weighted wind, solar and demand signal per market, hour and kind of data."""
    weights = [weight for _, weight in signals.values()]
    points = locations.select("location_id", "market_id", *weights)
    return (
        fact_weather.join(points, "location_id")
        .groupBy("market_id", "hour_start_utc", "data_type")
        .agg(*[_weighted(v, w).alias(f"{name}_signal") for name, (v, w) in signals.items()])
    )


def weather_hourly(
    fact_weather: DataFrame, locations: DataFrame, market_id: str | None = None,
    start: date | None = None, end: date | None = None,
) -> DataFrame:
    """Per-location weather next to its market's national signals, of one market and local days if asked."""
    if market_id is not None:
        locations = locations.filter(F.col("market_id") == market_id)
    if start is not None:
        fact_weather = fact_weather.filter(F.col("date_id") >= ft.date_id_of(start))
    if end is not None:
        fact_weather = fact_weather.filter(F.col("date_id") <= ft.date_id_of(end))
    named = fact_weather.join(
        locations.select("location_id", "location_name", "market_id"), "location_id"
    )
    national = national_weather(fact_weather, locations)
    return named.join(national, ["market_id", "hour_start_utc", "data_type"])


def cross_grain(
    fact_price: DataFrame, fact_generation: DataFrame, types: DataFrame, fact_load: DataFrame
) -> DataFrame:
    """Hourly price, renewable share and load side by side.

    Each input is brought to one row per market and local hour first, so joining
    them multiplies nothing.  A slot's clock position tells how far into its hour
    it lies, whatever the zone's offset.
    """
    keys = ["market_id", "hour_start_utc"]
    into_hour = F.col("local_time_id") % ft.SLOTS_PER_HOUR * ft.SLOT_SECONDS
    hour = F.timestamp_seconds(F.unix_timestamp("timestamp_utc") - into_hour)
    price = (
        fact_price.withColumn("hour_start_utc", hour)
        .groupBy(*keys)
        .agg(F.avg("price_eur_mwh").alias("avg_price_eur_mwh"))
    )
    flags = types.select("production_type_id", "is_renewable")
    mix = (
        fact_generation.join(flags, "production_type_id", "left")
        .groupBy(*keys)
        .agg(
            F.sum(F.when(F.col("is_renewable"), F.col("actual_mw")).otherwise(0.0)).alias("_part"),
            F.sum("actual_mw").alias("_whole"),
        )
        .select(*keys, (share_pct("_part", "_whole") / 100.0).alias("renewable_share"))
    )
    load = fact_load.select(*keys, "actual_load_mw")
    return price.join(mix, keys).join(load, keys, "left")


def price_with_weather(fact_price: DataFrame, weather: DataFrame) -> DataFrame:
    """Quarter-hour prices with the hour's weather averaged over a market's locations.

    ``weather`` carries market_id, timestamp_utc and the measured variables; it is
    aggregated before the left join, so no price row is repeated.
    """
    names = {
        "temperature_2m": "temp_avg_c",
        "wind_speed_10m": "wind_speed_10m_avg",
        "wind_speed_100m": "wind_speed_100m_avg",
        "shortwave_radiation": "solar_radiation_avg",
        "cloud_cover": "cloud_cover_avg",
    }
    hour = ft.hour_start_utc("timestamp_utc")
    means = (
        weather.groupBy("market_id", hour.alias("hour_start_utc"))
        .agg(*[F.avg(c).alias(alias) for c, alias in names.items()])
    )
    return fact_price.withColumn("hour_start_utc", hour).join(
        means, ["market_id", "hour_start_utc"], "left"
    )


def rate_cross_check(
    observations: DataFrame, primary: str, secondary: str, tolerance: float = 0.01
) -> DataFrame:
    """Days on which two sources both publish a pair, and how far they differ."""
    keys = ["date", "base_currency", "quote_currency"]

    def of(source: str, alias: str) -> Column:
        return F.max(F.when(F.col("source") == source, F.col("rate"))).alias(alias)

    both = observations.groupBy(*keys).agg(
        of(primary, "primary_rate"), of(secondary, "secondary_rate")
    ).dropna(subset=["primary_rate", "secondary_rate"])
    deviation = F.try_divide(
        F.abs(F.col("secondary_rate") - F.col("primary_rate")), F.abs("primary_rate")
    )
    return both.withColumn("deviation", deviation).withColumn(
        "exceeds", F.coalesce(deviation > tolerance, F.lit(False))
    )


def price_outliers(
    prices: DataFrame, day: tuple[str, ...] = ("market_id", "delivery_date"), sigmas: float = 3.0
) -> DataFrame:
    """Flag prices far above their day's mean; add the buy/sell ratio, NULL when undefined.

    A day is keyed by slot, so the window group holds at most 100 rows.
    """
    whole = Window.partitionBy(*day)
    price = F.col("price_lei_mwh")
    limit = F.avg(price).over(whole) + sigmas * F.stddev_samp(price).over(whole)
    return prices.withColumn("is_price_outlier", F.coalesce(price > limit, F.lit(False))).withColumn(
        "buy_sell_ratio", F.try_divide("volume_buy_mw", "volume_sell_mw")
    )
