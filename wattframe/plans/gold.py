"""Gold: hourly prices, the wide generation mix and battery signals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import time as ft
from ..operators.rank import CHARGE_SLOTS, DISCHARGE_SLOTS, with_signals
from ..operators.resample import mean_by
from ..operators.wide import share_pct, wide_mix
from ..registry import mix_columns, zones
from .silver import Markets, with_market


def price_hourly(fact_price: DataFrame, markets: Markets) -> DataFrame:
    """Hourly means with clock labels and the market's peak flag.

    The bucket is the first instant of the local hour, so a changeover day has
    its 23 or 25 hours and zones off the full hour get labels too.
    """
    tz, local = zones(markets), F.col("_local")
    of_market = ["timezone", "peak_start_hour", "peak_end_hour"]
    hourly = mean_by(
        with_market(fact_price, markets, *of_market),
        ["market_id"],
        {"hour_start_utc": ft.local_hour_start_utc("timestamp_utc", tz)},
        ["price_local_mwh", "price_eur_mwh"],
        labels=["fx_rate", *of_market],
    )
    zoned = hourly.withColumn("_local", ft.local_time("hour_start_utc", tz))
    return zoned.select(
        ft.date_id(local).alias("date_id"),
        ft.clock_position(local).alias("time_id"),
        "hour_start_utc",
        "market_id",
        "price_local_mwh",
        "fx_rate",
        "price_eur_mwh",
        (
            (F.hour(local) >= F.col("peak_start_hour")) & (F.hour(local) < F.col("peak_end_hour"))
        ).alias("is_peak"),
        ft.clock_label(local).alias("time_label"),
        ft.is_repeated("hour_start_utc", tz).alias("is_repeated_hour"),
    )


def generation_hourly(
    fact_generation: DataFrame, types: DataFrame, columns: Mapping[str, str] | None = None
) -> DataFrame:
    """One wide row per market and UTC hour.

    Keyed on the instant: the hour that occurs twice in autumn stays two rows,
    and an hour with only discovered types is kept.
    """
    named = types.select(
        "production_type_id", "production_type_name", "is_renewable", "energy_category"
    )
    mix = wide_mix(
        fact_generation.join(named, "production_type_id", "left"),
        ["market_id", "hour_start_utc"],
        "production_type_name",
        "actual_mw",
        mix_columns() if columns is None else columns,
        {
            "renewable_mw": F.col("is_renewable"),
            "thermal_mw": F.col("energy_category") == "Thermal",
            "nuclear_mw_total": F.col("energy_category") == "Nuclear",
        },
        labels=["date_id", "time_id"],
    )
    return mix.withColumn("renewable_share_pct", share_pct("renewable_mw", "total_mw"))


def bess_signals(
    fact_price: DataFrame,
    markets: Markets,
    charge_slots: int = CHARGE_SLOTS,
    discharge_slots: int = DISCHARGE_SLOTS,
) -> DataFrame:
    """Per quarter hour: price ranks of the day and charge (-1), idle (0) or discharge (+1).

    ``fact_price`` is keyed by (market, instant), so a ranked day has at most 100 rows.
    """
    ranked = with_signals(
        fact_price, ["market_id", "date_id"],
        charge_slots=charge_slots, discharge_slots=discharge_slots,
    )
    local = ft.local_time("timestamp_utc", zones(markets))
    return with_market(ranked, markets, "timezone").select(
        "date_id",
        F.col("local_time_id").alias("time_id"),
        "interval_of_day",
        "timestamp_utc",
        "market_id",
        ft.clock_label(local).alias("time_label"),
        "price_local_mwh",
        "price_eur_mwh",
        "price_rank_asc",
        "price_rank_desc",
        "signal",
        "daily_min_price_eur_mwh",
        "daily_max_price_eur_mwh",
        "arbitrage_spread_eur_mwh",
    )
