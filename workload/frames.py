"""Energy-shaped inputs derived from the given tables, and the same derivations as SQL.

Amounts are multiples of 1/4, quarter-hour readings multiples of 12 and rates
powers of two, so sums, hourly means and quotients are exact and do not depend on
the order of summation.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from wattframe.plans import dims, gold, silver
from wattframe.registry import (
    PRODUCTION_TYPES, Location, Market, markets_frame, production_types_frame,
)
from wattframe.session import pin_utc

# Three zones with different changeover hours; weights are powers of two.
PLACES = (
    Location("Bucharest", 44.4268, 26.1025, 0.5, 0.25, 0.125),
    Location("Dobrogea", 44.18, 28.65, 0.25, 0.125, 0.0625),
    Location("Oltenia", 44.32, 23.8, 0.125, 0.0625, 0.5),
    Location("Transylvania", 46.7712, 23.5938, 0.0625, 0.5, 0.25),
    Location("Moldova", 47.1585, 27.5907, 0.03125, 0.03125, 0.03125),
    Location("Banat", 45.7489, 21.2087, 0.03125, 0.03125, 0.03125),
)
MARKETS = {
    "RO": Market("10YRO-TEL------P", "Europe/Bucharest", "RON", "Romania", locations=PLACES),
    "DE": Market("10Y1001A1001A83F", "Europe/Berlin", "EUR", "Germany", fx_source="ECB", locations=PLACES),
    "GB": Market(
        "10YGB----------A", "Europe/London", "GBP", "Great Britain", fx_source="ECB", locations=PLACES,
        peak_start_hour=7, peak_end_hour=19,
    ),
}
# The stored type dimension after one discovery.
TYPES = (*PRODUCTION_TYPES, ("Tidal Kite", "Other", False, False, False))
FX_START, FX_END = date(1995, 1, 1), date(2001, 12, 31)
# The events lie in January 2024; 285 days later they span the autumn changeover,
# 65 days later the spring one.
AUTUMN, SPRING = 285, 65
GEN_START, GEN_END = date(2024, 10, 1), date(2024, 12, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def zoneless(df: DataFrame) -> DataFrame:
    """Timestamps as plain UTC wall-clock values."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, TimestampType) else F.col(f.name)
            for f in df.schema
        ]
    )


def choose(value: Column, *options: str) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (value % len(options) + 1).cast("int"))


def shifted(ts: str, micros: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(F.col(ts).cast("timestamp")) + micros)


def quarters(amount: str) -> Column:
    return F.floor(F.col(amount) * 4).cast("double") / 4


def markets(spark: SparkSession) -> DataFrame:
    return markets_frame(spark, MARKETS)


def lineitem_market() -> Column:
    flag = F.col("l_returnflag")
    return F.when(flag == "A", "RO").when(flag == "N", "DE").otherwise("GB")


def price_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as quarter-hour price observations with revisions."""
    slot = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13 + F.col("l_partkey")) % 100 + 1
    lag = (F.col("l_orderkey") % 86400) * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        lineitem_market().alias("market_id"),
        F.col("l_shipdate").cast("date").alias("delivery_date"),
        slot.cast("int").alias("interval_15min"),
        F.when(
            F.col("l_discount") != 0, F.floor("l_extendedprice").cast("double") - 50000
        ).alias("price_lei_mwh"),
        F.col("l_quantity").alias("volume_mw"),
        F.col("l_linenumber").cast("double").alias("volume_buy_mw"),
        F.round(F.col("l_tax") * 100).alias("volume_sell_mw"),
        shifted("l_shipdate", lag).alias("ingested_at"),
    )


def _rate() -> Column:
    return F.pow(F.lit(2.0), F.col("o_custkey") % 3 + 1)


def bnr_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in status P as published lei rates; later orders of a day are revisions."""
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(
        F.col("o_orderdate").cast("date").alias("date"),
        F.lit("EUR").alias("foreign_currency"),
        _rate().alias("rate_ron"),
        (F.col("o_orderkey") % 2 + 1).cast("int").alias("multiplier"),
        shifted("o_orderdate", F.col("o_orderkey")).alias("ingested_at"),
    )


def ecb_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in status F as RON rates and in status O as GBP rates."""
    return table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(F.col("o_orderstatus") == "F", "RON").otherwise("GBP").alias("quote_currency"),
        _rate().alias("rate"),
        shifted("o_orderdate", F.col("o_orderkey")).alias("ingested_at"),
    )


def exchange_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.exchange_rates(
        bnr_obs(spark, sf_dir), ecb_obs(spark, sf_dir), MARKETS, FX_START, FX_END
    )


def fact_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.fact_price(
        price_obs(spark, sf_dir), exchange_rates(spark, sf_dir), MARKETS, FX_START, FX_END
    )


def event_market() -> Column:
    return choose(F.col("user_id"), "RO", "DE", "GB")


def event_type_name() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "view", "Solar").when(kind == "click", "Wind Onshore")
        .when(kind == "purchase", "Nuclear").when(kind == "signup", "Fossil Gas")
        .otherwise("Tidal Kite")
    )


def days(count: int) -> Column:
    return F.lit(count * 86400 * 1000000)


def gen_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as quarter-hour generation readings with revisions; one type is unlisted."""
    slot = F.floor(F.unix_timestamp(shifted("ts", days(AUTUMN))) / 900) * 900
    return table(spark, sf_dir, "events").select(
        event_market().alias("market_id"),
        F.timestamp_seconds(slot).alias("timestamp_utc"),
        event_type_name().alias("production_type"),
        F.when(F.col("event_id") % 50 != 0, F.floor("value").cast("double") * 12).alias("actual_mw"),
        F.col("ts").cast("timestamp").alias("ingested_at"),
    )


def load_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gen_obs(spark, sf_dir).select(
        "market_id", "timestamp_utc", F.col("actual_mw").alias("actual_load_mw"), "ingested_at"
    )


def production_types(spark: SparkSession) -> DataFrame:
    return production_types_frame(spark, TYPES)


def fact_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.fact_generation(
        gen_obs(spark, sf_dir), production_types(spark), MARKETS, GEN_START, GEN_END
    )


def generation_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.generation_hourly(fact_generation(spark, sf_dir), production_types(spark))


def fact_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.fact_load(load_obs(spark, sf_dir), MARKETS, GEN_START, GEN_END)


PLACE_NAMES = (*[p.name for p in PLACES], "Atlantis")


def weather_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as hourly weather readings; one place is not configured."""
    event = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        event_market().alias("market_id"),
        choose(F.col("user_id"), *PLACE_NAMES).alias("location_name"),
        F.date_trunc("hour", shifted("ts", days(AUTUMN))).alias("timestamp_utc"),
        F.when(F.col("event_type").isin("view", "click"), "FORECAST").otherwise("REALIZED").alias("data_type"),
        quarters("value").alias("temperature_2m"),
        (F.col("user_id") * 0.25).alias("wind_speed_10m"),
        F.when(event % 20 != 0, event % 101 * 0.25).alias("wind_speed_100m"),
        (event % 1000).cast("double").alias("shortwave_radiation"),
        (event % 101).cast("double").alias("cloud_cover"),
        F.col("ts").cast("timestamp").alias("ingested_at"),
    )


def fact_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.fact_weather(
        weather_obs(spark, sf_dir), dims.dim_location(markets(spark)), MARKETS, GEN_START, GEN_END
    )


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()


def order_zone_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order day in each of the three zones."""
    return in_every_zone(order_days(spark, sf_dir))


def in_every_zone(days: DataFrame) -> DataFrame:
    zones = F.array(*[F.lit(m.timezone) for m in MARKETS.values()])
    return days.withColumn("timezone", F.explode(zones))


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests; every tenth user is unauthenticated."""
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.when(user % 10 != 0, user).alias("key_id"),
        F.col("ts").cast("timestamp").alias("occurred_at"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        quarters("value").alias("duration_ms"),
    )


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("display"),
        F.col("c_mktsegment").alias("name"),
        (F.col("c_nationkey") % 3 + 1).alias("rate_limit_per_min"),
    )


def currency_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest order price per day and currency, the currency standing for a priority."""
    priority = F.substring("o_orderpriority", 1, 1).cast("int")
    names = F.array(*[F.lit(c) for c in ("EUR", "USD", "GBP", "JPY", "CHF")])
    return table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderdate").cast("date").alias("date"), F.element_at(names, priority).alias("currency")
    ).agg(F.min("o_totalprice").alias("rate"))


# ---- the same derivations in SQL ---------------------------------------------------

def instant(local: str, zone: str) -> str:
    """UTC instant of a local timestamp expression."""
    return f"timezone('UTC', timezone({zone}, CAST({local} AS TIMESTAMP)))"


def local(ts: str, zone: str) -> str:
    return f"timezone({zone}, timezone('UTC', {ts}))"


def date_id(expression: str) -> str:
    return f"CAST(strftime({expression}, '%Y%m%d') AS INTEGER)"


def clock(expression: str) -> str:
    return f"CAST(hour({expression}) * 4 + minute({expression}) // 15 AS INTEGER)"


def pick(value: str, *options: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options))
    return f"CASE {value} % {len(options)} {cases} END"


CTES = {
    "mkt": """
SELECT * FROM (VALUES
  ('RO', 'Europe/Bucharest', 'RON', 'EUR', 8, 20),
  ('DE', 'Europe/Berlin', 'EUR', 'EUR', 8, 20),
  ('GB', 'Europe/London', 'GBP', 'EUR', 7, 19)
) v(market_id, timezone, currency, reporting_currency, peak_start, peak_end)""",
    "price_obs": """
SELECT CASE l_returnflag WHEN 'A' THEN 'RO' WHEN 'N' THEN 'DE' ELSE 'GB' END AS market_id,
  CAST(l_shipdate AS DATE) AS delivery_date,
  CAST((l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 100 + 1 AS INTEGER) AS interval_15min,
  CASE WHEN l_discount <> 0 THEN floor(l_extendedprice) - 50000 END AS price_lei_mwh,
  l_quantity AS volume_mw, CAST(l_linenumber AS DOUBLE) AS volume_buy_mw,
  round(l_tax * 100) AS volume_sell_mw,
  make_timestamp(epoch_us(l_shipdate) + (l_orderkey % 86400) * 1000000 + l_partkey * 10 + l_linenumber)
    AS ingested_at
FROM lineitem""",
    "price_latest": """
SELECT * FROM price_obs QUALIFY row_number() OVER (
  PARTITION BY market_id, delivery_date, interval_15min ORDER BY ingested_at DESC) = 1""",
    "bnr_latest": """
SELECT CAST(o_orderdate AS DATE) AS date, 'EUR' AS base_currency, 'RON' AS quote_currency,
  'BNR' AS source, pow(2.0, o_custkey % 3 + 1) / (o_orderkey % 2 + 1) AS rate
FROM orders WHERE o_orderstatus = 'P'
QUALIFY row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) = 1""",
    "ecb_latest": """
SELECT CAST(o_orderdate AS DATE) AS date, 'EUR' AS base_currency,
  CASE o_orderstatus WHEN 'F' THEN 'RON' ELSE 'GBP' END AS quote_currency,
  'ECB' AS source, CAST(pow(2.0, o_custkey % 3 + 1) AS DOUBLE) AS rate
FROM orders WHERE o_orderstatus <> 'P'
QUALIFY row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE), o_orderstatus
  ORDER BY o_orderkey DESC) = 1""",
    "fx": """
SELECT date, 'EUR' AS base_currency, quote_currency,
  CASE quote_currency WHEN 'EUR' THEN 1.0::DOUBLE ELSE filled END AS rate,
  CASE WHEN quote_currency = 'EUR' THEN 'SYNTHETIC' WHEN seen IS NULL THEN 'FORWARD_FILLED'
    ELSE source END AS source
FROM (
  SELECT d.date, q.quote_currency, coalesce(b.rate, e.rate) AS seen,
    coalesce(b.source, e.source) AS source,
    last_value(coalesce(b.rate, e.rate) IGNORE NULLS) OVER (
      PARTITION BY q.quote_currency ORDER BY d.date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled
  FROM (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS date) d
  CROSS JOIN (VALUES ('RON'), ('GBP'), ('EUR')) q(quote_currency)
  LEFT JOIN bnr_latest b ON b.date = d.date AND b.quote_currency = q.quote_currency
  LEFT JOIN ecb_latest e ON e.date = d.date AND e.quote_currency = q.quote_currency
) WHERE quote_currency = 'EUR' OR filled IS NOT NULL""",
    "price_slots": f"""
SELECT p.*, m.timezone, m.currency, m.reporting_currency,
  {instant('p.delivery_date', 'm.timezone')} + to_minutes(15 * (p.interval_15min - 1)) AS timestamp_utc,
  p.interval_15min <= date_diff('minute', {instant('p.delivery_date', 'm.timezone')},
    {instant('p.delivery_date + 1', 'm.timezone')}) / 15 AS on_axis
FROM price_latest p JOIN mkt m USING (market_id)""",
    "fact_price": f"""
SELECT {date_id('p.delivery_date')} AS date_id, p.interval_15min AS interval_of_day, p.timestamp_utc,
  {clock(local('p.timestamp_utc', 'p.timezone'))} AS local_time_id, p.market_id,
  p.price_lei_mwh AS price_local_mwh, fx.rate AS fx_rate,
  CASE WHEN fx.rate <> 0 THEN p.price_lei_mwh / fx.rate END AS price_eur_mwh
FROM price_slots p LEFT JOIN fx ON fx.date = p.delivery_date
  AND fx.quote_currency = p.currency AND fx.base_currency = p.reporting_currency
WHERE p.on_axis""",
    "price_hourly": f"""
SELECT {date_id('loc')} AS date_id, {clock('loc')} AS time_id, hour_start_utc, market_id,
  price_local_mwh, fx_rate, price_eur_mwh,
  hour(loc) >= peak_start AND hour(loc) < peak_end AS is_peak,
  strftime(loc, '%H:%M') AS time_label,
  {local('hour_start_utc - INTERVAL 1 HOUR', 'timezone')} = loc AS is_repeated_hour
FROM (
  SELECT date_trunc('hour', timestamp_utc) AS hour_start_utc, market_id, any_value(timezone) AS timezone,
    any_value(peak_start) AS peak_start, any_value(peak_end) AS peak_end,
    avg(price_local_mwh) AS price_local_mwh, max(fx_rate) AS fx_rate, avg(price_eur_mwh) AS price_eur_mwh,
    any_value({local("date_trunc('hour', timestamp_utc)", 'timezone')}) AS loc
  FROM fact_price JOIN mkt USING (market_id) GROUP BY 1, 2)""",
    "signals": f"""
SELECT *, CASE WHEN price_eur_mwh IS NULL THEN 0 WHEN price_rank_asc <= 2 THEN -1
    WHEN price_rank_desc <= 2 THEN 1 ELSE 0 END AS signal,
  daily_max_price_eur_mwh - daily_min_price_eur_mwh AS arbitrage_spread_eur_mwh
FROM (
  SELECT date_id, local_time_id AS time_id, interval_of_day, timestamp_utc, market_id,
    strftime({local('timestamp_utc', 'timezone')}, '%H:%M') AS time_label,
    price_local_mwh, price_eur_mwh,
    CASE WHEN price_eur_mwh IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY market_id, date_id
      ORDER BY price_eur_mwh ASC NULLS LAST, timestamp_utc ASC) AS INTEGER) END AS price_rank_asc,
    CASE WHEN price_eur_mwh IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY market_id, date_id
      ORDER BY price_eur_mwh DESC NULLS LAST, timestamp_utc DESC) AS INTEGER) END AS price_rank_desc,
    min(price_eur_mwh) OVER (PARTITION BY market_id, date_id) AS daily_min_price_eur_mwh,
    max(price_eur_mwh) OVER (PARTITION BY market_id, date_id) AS daily_max_price_eur_mwh
  FROM fact_price JOIN mkt USING (market_id))""",
    "windows": """
SELECT market_id, date_id, min(timestamp_utc) AS start_utc,
  arg_min(time_id, timestamp_utc) AS start_time_id, arg_max(time_id, timestamp_utc) AS end_time_id,
  arg_min(time_label, timestamp_utc) AS start_label, arg_max(time_label, timestamp_utc) AS end_label,
  avg(price_eur_mwh) AS avg_price_eur_mwh, count(*) AS n_slots,
  max(arbitrage_spread_eur_mwh) AS arbitrage_spread_eur_mwh,
  CASE signal WHEN -1 THEN 'charge' ELSE 'discharge' END AS type
FROM (
  SELECT *, row_number() OVER (PARTITION BY market_id, date_id ORDER BY timestamp_utc)
    - row_number() OVER (PARTITION BY market_id, date_id, signal ORDER BY timestamp_utc) AS island
  FROM signals)
WHERE signal <> 0 GROUP BY market_id, date_id, signal, island""",
    "gen_obs": f"""
SELECT {pick('user_id', 'RO', 'DE', 'GB')} AS market_id,
  make_timestamp((epoch_us(ts + INTERVAL {AUTUMN} DAY) // 900000000) * 900000000) AS timestamp_utc,
  CASE event_type WHEN 'view' THEN 'Solar' WHEN 'click' THEN 'Wind Onshore' WHEN 'purchase' THEN 'Nuclear'
    WHEN 'signup' THEN 'Fossil Gas' ELSE 'Tidal Kite' END AS production_type,
  CASE WHEN event_id % 50 <> 0 THEN floor(value) * 12 END AS actual_mw, ts AS ingested_at
FROM events""",
    "gen_latest": """
SELECT * FROM gen_obs QUALIFY row_number() OVER (
  PARTITION BY market_id, timestamp_utc, production_type ORDER BY ingested_at DESC) = 1""",
    "load_latest": """
SELECT market_id, timestamp_utc, actual_mw AS actual_load_mw FROM gen_obs QUALIFY row_number() OVER (
  PARTITION BY market_id, timestamp_utc ORDER BY ingested_at DESC) = 1""",
    "types": """
SELECT * FROM (VALUES (4, 'Fossil Gas', 'Thermal', false), (15, 'Nuclear', 'Nuclear', false),
  (18, 'Solar', 'Renewable', true), (21, 'Wind Onshore', 'Renewable', true),
  (22, 'Tidal Kite', 'Other', false)) v(production_type_id, production_type, energy_category, is_renewable)""",
    "fact_generation": f"""
SELECT max({date_id(local('timestamp_utc', 'timezone'))}) AS date_id,
  max(CAST(hour({local('timestamp_utc', 'timezone')}) * 4 AS INTEGER)) AS time_id,
  date_trunc('hour', timestamp_utc) AS hour_start_utc, market_id, production_type_id, avg(actual_mw) AS actual_mw
FROM gen_latest JOIN types USING (production_type) JOIN mkt USING (market_id)
GROUP BY date_trunc('hour', timestamp_utc), market_id, production_type_id""",
    "fact_load": f"""
SELECT max({date_id(local('timestamp_utc', 'timezone'))}) AS date_id,
  max(CAST(hour({local('timestamp_utc', 'timezone')}) * 4 AS INTEGER)) AS time_id,
  date_trunc('hour', timestamp_utc) AS hour_start_utc, market_id, avg(actual_load_mw) AS actual_load_mw
FROM load_latest JOIN mkt USING (market_id) GROUP BY date_trunc('hour', timestamp_utc), market_id""",
    "mix": """
SELECT market_id, hour_start_utc, max(date_id) AS date_id, max(time_id) AS time_id,
  coalesce(max(actual_mw) FILTER (production_type_id = 18), 0.0::DOUBLE) AS solar_mw,
  coalesce(max(actual_mw) FILTER (production_type_id = 21), 0.0::DOUBLE) AS wind_onshore_mw,
  coalesce(max(actual_mw) FILTER (production_type_id = 15), 0.0::DOUBLE) AS nuclear_mw,
  coalesce(max(actual_mw) FILTER (production_type_id = 4), 0.0::DOUBLE) AS fossil_gas_mw,
  coalesce(sum(actual_mw) FILTER (production_type_id = 22), 0.0::DOUBLE) AS other_discovered_mw,
  sum(actual_mw) AS total_mw,
  sum(CASE WHEN is_renewable THEN actual_mw ELSE 0 END) AS renewable_mw,
  sum(CASE WHEN energy_category = 'Thermal' THEN actual_mw ELSE 0 END) AS thermal_mw,
  sum(CASE WHEN energy_category = 'Nuclear' THEN actual_mw ELSE 0 END) AS nuclear_mw_total,
  CASE WHEN sum(actual_mw) > 0 THEN sum(CASE WHEN is_renewable THEN actual_mw ELSE 0 END)
    / sum(actual_mw) * 100.0 END AS renewable_share_pct
FROM fact_generation JOIN types USING (production_type_id) GROUP BY 1, 2""",
    "weather_latest": f"""
SELECT {pick('user_id', 'RO', 'DE', 'GB')} AS market_id, {pick('user_id', *PLACE_NAMES)} AS location_name,
  date_trunc('hour', ts + INTERVAL {AUTUMN} DAY) AS timestamp_utc,
  CASE WHEN event_type IN ('view', 'click') THEN 'FORECAST' ELSE 'REALIZED' END AS data_type,
  floor(value * 4) / 4 AS temperature_2m, user_id * 0.25::DOUBLE AS wind_speed_10m,
  CASE WHEN event_id % 20 <> 0 THEN event_id % 101 * 0.25::DOUBLE END AS wind_speed_100m,
  CAST(event_id % 1000 AS DOUBLE) AS shortwave_radiation, CAST(event_id % 101 AS DOUBLE) AS cloud_cover
FROM events QUALIFY row_number() OVER (
  PARTITION BY market_id, location_name, timestamp_utc, data_type ORDER BY ts DESC) = 1""",
    "places": """
SELECT market_id, v.*,
  CAST(CAST('0x' || substr(md5(market_id || '::' || location_name), 1, 8) AS BIGINT) % 900000 + 100000 AS INTEGER)
  AS location_id
FROM mkt CROSS JOIN (VALUES ('Bucharest', 0.5, 0.25, 0.125), ('Dobrogea', 0.25, 0.125, 0.0625),
  ('Oltenia', 0.125, 0.0625, 0.5), ('Transylvania', 0.0625, 0.5, 0.25),
  ('Moldova', 0.03125, 0.03125, 0.03125), ('Banat', 0.03125, 0.03125, 0.03125))
  v(location_name, wind_weight, solar_weight, demand_weight)""",
    "fact_weather": f"""
SELECT {date_id(local('timestamp_utc', 'timezone'))} AS date_id,
  CAST(hour({local('timestamp_utc', 'timezone')}) * 4 AS INTEGER) AS time_id,
  timestamp_utc AS hour_start_utc, location_id, data_type, temperature_2m AS temperature_c,
  wind_speed_100m AS wind_speed_ms, shortwave_radiation AS solar_irradiance_wm2,
  cloud_cover AS cloud_cover_pct
FROM weather_latest JOIN places USING (market_id, location_name) JOIN mkt USING (market_id)""",
    "national": """
SELECT market_id, hour_start_utc, data_type,
  sum(wind_speed_ms * wind_weight) / sum(CASE WHEN wind_speed_ms IS NOT NULL THEN wind_weight END)::DOUBLE AS wind_signal,
  sum(solar_irradiance_wm2 * solar_weight) / sum(solar_weight)::DOUBLE AS solar_signal,
  sum(temperature_c * demand_weight) / sum(demand_weight)::DOUBLE AS demand_signal
FROM fact_weather JOIN places USING (location_id) GROUP BY market_id, hour_start_utc, data_type""",
    "order_days": "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders",
    "zones": "SELECT * FROM (VALUES ('Europe/Bucharest', 120), ('Europe/Berlin', 60), ('Europe/London', 0)) v(timezone, standard)",
    "axis": f"""
SELECT *, date_diff('minute', timestamp_utc, loc) AS utc_offset,
  row_number() OVER (PARTITION BY timezone, date ORDER BY timestamp_utc) AS slot,
  row_number() OVER (PARTITION BY timezone, date, loc ORDER BY timestamp_utc) > 1 AS repeated
FROM (
  SELECT *, {local('timestamp_utc', 'timezone')} AS loc
  FROM (
    SELECT date, timezone, standard, unnest(generate_series({instant('date', 'timezone')},
      {instant('date + 1', 'timezone')} - INTERVAL 15 MINUTE, INTERVAL 15 MINUTE)) AS timestamp_utc
    FROM order_days CROSS JOIN zones))""",
    "usage_events": """
SELECT CASE WHEN user_id % 10 <> 0 THEN user_id END AS key_id, ts AS occurred_at,
  CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status_code, floor(value * 4) / 4 AS duration_ms
FROM events""",
    "currency_rates": """
SELECT CAST(o_orderdate AS DATE) AS date,
  ['EUR', 'USD', 'GBP', 'JPY', 'CHF'][CAST(o_orderpriority[1] AS INTEGER)] AS currency,
  min(o_totalprice) AS rate
FROM orders GROUP BY 1, 2""",
}
NEEDS = {
    "price_latest": ("price_obs",),
    "fx": ("bnr_latest", "ecb_latest"),
    "price_slots": ("price_latest", "mkt"),
    "fact_price": ("price_slots", "fx"),
    "price_hourly": ("fact_price", "mkt"),
    "signals": ("fact_price", "mkt"),
    "windows": ("signals",),
    "gen_latest": ("gen_obs",),
    "load_latest": ("gen_obs",),
    "fact_generation": ("gen_latest", "types", "mkt"),
    "fact_load": ("load_latest", "mkt"),
    "mix": ("fact_generation", "types"),
    "places": ("mkt",),
    "fact_weather": ("weather_latest", "places", "mkt"),
    "national": ("fact_weather", "places"),
    "axis": ("order_days", "zones"),
}


def sql(body: str, *needs: str) -> str:
    """``body`` preceded by the named derivations and what they rest on."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in NEEDS.get(name, ()):
            visit(other)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    ctes = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in order)
    return f"WITH {ctes}\n{body.strip()}" if order else body.strip()
