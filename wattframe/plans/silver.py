"""Silver: reconciled rates and the four fact tables.

Each builder takes frames and gives a frame for any number of markets at once.
``markets`` is the registry; its frame is as small as the configuration, which is
why it is the one side that is broadcast unconditionally.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money
from ..functions import time as ft
from ..operators.fill import reconcile_rates
from ..operators.latest import latest_per_key
from ..operators.resample import mean_by
from ..registry import Market, markets_frame, required_pairs, zones
from ..schemas import ENTSOE_GENERATION, ENTSOE_LOAD, OPCOM_PRICES, WEATHER, Table

Markets = Mapping[str, Market]


def with_market(df: DataFrame, markets: Markets, *columns: str, how: str = "inner") -> DataFrame:
    """Add registry columns; rows of markets that are not configured drop out, or get NULL (``how="left"``).

    One market needs no join: its columns are literals.  (A join would even lose its key where ``market_id`` is a
    literal too, and become a nested loop.)
    """
    if len(markets) == 1:
        ((market_id, market),) = markets.items()
        own = F.col("market_id") == market_id
        if how == "left":
            return df.withColumns({c: F.when(own, getattr(market, c)) for c in columns})
        return df.filter(own).withColumns({c: F.lit(getattr(market, c)) for c in columns})
    registry = markets_frame(df.sparkSession, markets).select("market_id", *columns)
    return df.join(F.broadcast(registry), "market_id", how)


def current(df: DataFrame, table: Table) -> DataFrame:
    """The latest revision of every key.

    Rows of one key with the same ingest time, as one run stores them, are told
    apart by their values and then by the other columns, greatest first, so the
    outcome does not depend on row order.
    """
    return latest_per_key(df, table.keys, tiebreak=[c for c in table.tiebreak if c in df.columns])


def local_days(
    df: DataFrame, markets: Markets, start: date, end: date, ts: str = "timestamp_utc"
) -> DataFrame:
    """Rows of each market's local days [start, end], with local keys.

    A span of instants a day wider on both sides consists of literals and reaches
    the scan; the exact cut follows on the local date, whatever the zone.
    """
    low = datetime.combine(start - timedelta(days=1), datetime.min.time())
    high = datetime.combine(end + timedelta(days=2), datetime.min.time())
    near = df.filter((F.col(ts) >= F.lit(low)) & (F.col(ts) < F.lit(high)))
    keyed = ft.with_local_keys(with_market(near, markets, "timezone"), zones(markets), ts)
    return keyed.filter(F.col("date_id").between(ft.date_id_of(start), ft.date_id_of(end)))


#: What tells revisions of a rate apart: the ingest, then the values, then the other column of its table.
RATE_REVISION = ("ingested_at", "_value", "_per", "_origin")


def rate_revisions(bnr: DataFrame, ecb: DataFrame) -> DataFrame:
    """Rates per day, pair and source in one long frame, all revisions, with the columns that order them.

    The central bank quotes lei per foreign unit: the foreign currency is the
    base.  The ECB quotes units per euro.
    """
    def column(df: DataFrame, name: str):
        return (F.col(name) if name in df.columns else F.lit(None)).cast("string")

    national = bnr.select(
        "date",
        F.col("foreign_currency").alias("base_currency"),
        F.lit("RON").alias("quote_currency"),
        F.lit("BNR").alias("source"),
        money.per_unit_rate("rate_ron", "multiplier").alias("rate"),
        "ingested_at", F.col("rate_ron").alias("_value"), F.col("multiplier").alias("_per"), column(bnr, "source_url").alias("_origin"),
    )
    european = ecb.select(
        "date", F.lit("EUR").alias("base_currency"), "quote_currency",
        F.lit("ECB").alias("source"), "rate",
        "ingested_at", F.col("rate").alias("_value"), F.lit(1).alias("_per"), column(ecb, "source_file_date").alias("_origin"),
    )
    return national.unionByName(european)


def rate_observations(bnr: DataFrame, ecb: DataFrame) -> DataFrame:
    """Current rate per day, pair and source."""
    last = F.max(F.struct(*RATE_REVISION, "rate")).alias("_last")
    keys = ["date", "base_currency", "quote_currency", "source"]
    return rate_revisions(bnr, ecb).groupBy(*keys).agg(last).select(*keys, F.col("_last.rate").alias("rate"))


def exchange_rates(
    bnr: DataFrame, ecb: DataFrame, markets: Markets, start: date, end: date
) -> DataFrame:
    """Daily rate per required pair for [start, end], without gaps once rates begin."""
    so_far = F.col("date") <= F.lit(end)
    observations = rate_revisions(bnr.filter(so_far), ecb.filter(so_far))
    pairs = required_pairs(markets_frame(bnr.sparkSession, markets))
    return reconcile_rates(observations, pairs, start, end, RATE_REVISION)


def daily_rates(rates: DataFrame, markets: Markets, start: date, end: date) -> DataFrame:
    """Rates that a market's prices of [start, end] are converted with.

    The rate table is keyed by date and pair.  How it meets the prices is left to
    the optimizer, which knows its size.
    """
    pairs = {(m.reporting_currency, m.currency) for m in markets.values()}
    wanted = F.concat_ws("/", "base_currency", "quote_currency").isin(["/".join(p) for p in pairs])
    return rates.filter(F.col("date").between(F.lit(start), F.lit(end)) & wanted).select(
        F.col("date").alias("delivery_date"),
        F.col("base_currency").alias("reporting_currency"),
        F.col("quote_currency").alias("currency"),
        F.col("rate").alias("fx_rate"),
    )


# ---- facts, with what they leave out ---------------------------------------------
#
# A marked frame holds the rows of a fact and, with a reason, those that stay out of it.  A job stores it once and takes
# both from it, so that the observations are read once.


def kept(marked: DataFrame) -> DataFrame:
    """The rows of the fact."""
    return marked.filter("_reason IS NULL").drop("_reason", "_key", "_rows")


def dropped(marked: DataFrame, table: str) -> DataFrame:
    """Observations left out, by reason and key."""
    out = marked.filter("_reason IS NOT NULL").groupBy("_reason", "_key").agg(F.sum("_rows").alias("dropped_rows"))
    return out.select(F.lit(table).alias("table"), F.col("_reason").alias("reason"), F.col("_key").alias("key"), "dropped_rows")


def _key(*columns: str):
    """Column values spelled as one text."""
    return F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def marked_prices(
    prices: DataFrame, rates: DataFrame | None, markets: Markets, start: date, end: date
) -> DataFrame:
    """Current prices as ``fact_price`` holds them; marked are unknown markets and slots that the day does not have.

    Slot numbers become instants by arithmetic, so the axis table is not joined.  Without ``rates`` nothing is converted.
    """
    in_range = F.col("delivery_date").between(F.lit(start), F.lit(end))
    latest = current(prices.filter(in_range), OPCOM_PRICES)
    zoned = with_market(latest, markets, "timezone", "currency", "reporting_currency", how="left")
    tz = zones(markets)
    unknown = F.col("timezone").isNull()
    slots = zoned.withColumns(
        {
            "timestamp_utc": ft.slot_start_utc("delivery_date", "interval_15min", tz),
            "_reason": F.when(unknown, "unknown market").when(
                ~F.coalesce(ft.slot_exists("delivery_date", "interval_15min", tz), F.lit(False)), "slot not on the axis"
            ),
            "_key": F.when(unknown, _key("market_id")).otherwise(_key("market_id", "delivery_date")),
        }
    )
    if rates is None:
        valued = slots.withColumn("fx_rate", F.lit(None).cast("double"))
    else:
        fx = daily_rates(rates, markets, start, end)
        valued = slots.join(fx, ["delivery_date", "reporting_currency", "currency"], "left")
    return valued.select(
        ft.date_id("delivery_date").alias("date_id"),
        F.col("interval_15min").alias("interval_of_day"),
        "timestamp_utc",
        ft.clock_position(ft.local_time("timestamp_utc", tz)).alias("local_time_id"),
        "market_id",
        F.col("price_lei_mwh").alias("price_local_mwh"),
        "fx_rate",
        money.convert("price_lei_mwh", "fx_rate").alias("price_eur_mwh"),
        "_reason", "_key", F.lit(1).alias("_rows"),
    )


def fact_price(
    prices: DataFrame, rates: DataFrame, markets: Markets, start: date, end: date
) -> DataFrame:
    """Quarter-hour prices on the instant axis, in local currency and converted."""
    return kept(marked_prices(prices, rates, markets, start, end))


def dropped_prices(prices: DataFrame, markets: Markets, start: date, end: date) -> DataFrame:
    """Current prices of the range that ``fact_price`` leaves out."""
    return dropped(marked_prices(prices, None, markets, start, end), "fact_price")


def marked_generation(
    generation: DataFrame, types: DataFrame, markets: Markets, start: date, end: date
) -> DataFrame:
    """Hourly mean per production type, bucketed on the local hour; marked are the hours of unknown types."""
    latest = current(local_days(generation, markets, start, end), ENTSOE_GENERATION)
    named = types.select("production_type_id", F.col("production_type_name").alias("production_type"))
    unknown = F.col("production_type_id").isNull()
    joined = latest.join(named, "production_type", "left").withColumn("_key", F.when(unknown, _key("production_type")))
    hourly = mean_by(
        joined,
        ["market_id", "production_type_id", "_key"],
        {"hour_start_utc": F.col("hour_start_utc")},
        ["actual_mw"],
        labels=["date_id", "time_id"],
        count="_rows",
    )
    return hourly.select(
        "date_id", "time_id", "hour_start_utc", "market_id", "production_type_id", "actual_mw",
        F.when(unknown, "unknown production type").alias("_reason"), "_key", "_rows",
    )


def fact_generation(
    generation: DataFrame, types: DataFrame, markets: Markets, start: date, end: date
) -> DataFrame:
    """Hourly mean per production type, bucketed on the local hour."""
    return kept(marked_generation(generation, types, markets, start, end))


def dropped_generation(
    generation: DataFrame, types: DataFrame, markets: Markets, start: date, end: date
) -> DataFrame:
    """Current readings of the range whose production type is unknown."""
    return dropped(marked_generation(generation, types, markets, start, end), "fact_generation")


def fact_load(load: DataFrame, markets: Markets, start: date, end: date) -> DataFrame:
    """Hourly mean load."""
    return mean_by(
        current(local_days(load, markets, start, end), ENTSOE_LOAD),
        ["market_id"],
        {"hour_start_utc": F.col("hour_start_utc")},
        ["actual_load_mw"],
        labels=["date_id", "time_id"],
    ).select("date_id", "time_id", "hour_start_utc", "market_id", "actual_load_mw")


def marked_weather(
    weather: DataFrame, locations: DataFrame, markets: Markets, start: date, end: date
) -> DataFrame:
    """Hourly weather per location, realized and forecast rows apart; marked are unknown places."""
    latest = current(local_days(weather, markets, start, end), WEATHER)
    points = locations.select("market_id", "location_name", "location_id")
    return latest.join(points, ["market_id", "location_name"], "left").select(
        "date_id", "time_id", "hour_start_utc", "location_id", "data_type",
        F.col("temperature_2m").alias("temperature_c"),
        F.col("wind_speed_100m").alias("wind_speed_ms"),
        F.col("shortwave_radiation").alias("solar_irradiance_wm2"),
        F.col("cloud_cover").alias("cloud_cover_pct"),
        F.when(F.col("location_id").isNull(), "unknown location").alias("_reason"),
        _key("market_id", "location_name").alias("_key"), F.lit(1).alias("_rows"),
    )


def fact_weather(
    weather: DataFrame, locations: DataFrame, markets: Markets, start: date, end: date
) -> DataFrame:
    """Hourly weather per location; realized and forecast rows stay apart."""
    return kept(marked_weather(weather, locations, markets, start, end))


def dropped_weather(
    weather: DataFrame, locations: DataFrame, markets: Markets, start: date, end: date
) -> DataFrame:
    """Current readings of the range whose place is unknown."""
    return dropped(marked_weather(weather, locations, markets, start, end), "fact_weather")
