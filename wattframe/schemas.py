"""Fixed schemas, keys and partitioning of every stored table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .registry import mix_columns


@dataclass(frozen=True)
class Table:
    """``columns`` is a DDL string; NOT NULL columns are checked by ``conform``.

    ``month_of`` names the column whose month is the last level of partitions; with ``buckets`` it is the
    only level, and the months are bucketed by the keys.
    """

    layer: str
    name: str
    columns: str
    keys: tuple[str, ...]
    partitions: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    month_of: str | None = None
    buckets: int = 0

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.columns)

    @property
    def tiebreak(self) -> tuple[str, ...]:
        """What tells rows of one key and ingest time apart: the values, then all other columns."""
        known = {*self.keys, *self.values, "ingested_at"}
        return (*self.values, *(f.name for f in self.schema if f.name not in known))

    def path(self, base: str) -> str:
        return f"{base.rstrip('/')}/{self.layer}/{self.name}"


def conform(df: DataFrame, table: Table) -> DataFrame:
    """Cast and order ``df`` to the table's schema; a NULL in a NOT NULL column fails the job."""
    columns = []
    for field in table.schema:
        value = F.col(field.name).cast(field.dataType)
        if not field.nullable:
            missing = F.raise_error(F.lit(f"NULL in {table.name}.{field.name}"))
            value = F.coalesce(value, missing.cast(field.dataType))
        columns.append(value.alias(field.name))
    return df.select(*columns)


OPCOM_PRICES = Table(
    "bronze", "opcom_pzu_prices",
    "market_id string not null, delivery_date date not null, interval_15min int not null, "
    "price_lei_mwh double, volume_mw double, volume_buy_mw double, volume_sell_mw double, "
    "ingested_at timestamp not null, source_url string",
    keys=("market_id", "delivery_date", "interval_15min"),
    month_of="delivery_date", buckets=8,
    values=("price_lei_mwh", "volume_mw", "volume_buy_mw", "volume_sell_mw"),
)
ENTSOE_GENERATION = Table(
    "bronze", "entsoe_generation",
    "market_id string not null, timestamp_utc timestamp not null, "
    "production_type string not null, actual_mw double, ingested_at timestamp not null",
    keys=("market_id", "timestamp_utc", "production_type"),
    month_of="timestamp_utc", buckets=8,
    values=("actual_mw",),
)
ENTSOE_LOAD = Table(
    "bronze", "entsoe_load",
    "market_id string not null, timestamp_utc timestamp not null, actual_load_mw double, "
    "ingested_at timestamp not null",
    keys=("market_id", "timestamp_utc"),
    month_of="timestamp_utc", buckets=8,
    values=("actual_load_mw",),
)
BNR_RATES = Table(
    "bronze", "bnr_fx_rates",
    "date date not null, foreign_currency string not null, rate_ron double not null, "
    "multiplier int not null, source_url string, ingested_at timestamp not null",
    keys=("date", "foreign_currency"),
    partitions=("foreign_currency",),
    values=("rate_ron", "multiplier"),
)
ECB_RATES = Table(
    "bronze", "ecb_fx_rates",
    "date date not null, quote_currency string not null, rate double not null, "
    "source_file_date date not null, ingested_at timestamp not null",
    keys=("date", "quote_currency"),
    partitions=("quote_currency",),
    values=("rate",),
)
WEATHER = Table(
    "bronze", "weather",
    "market_id string not null, location_name string not null, lat double, lon double, "
    "timestamp_utc timestamp not null, data_type string not null, temperature_2m double, "
    "wind_speed_10m double, wind_speed_100m double, shortwave_radiation double, "
    "cloud_cover double, ingested_at timestamp not null, source_url string",
    keys=("market_id", "location_name", "timestamp_utc", "data_type"),
    month_of="timestamp_utc", buckets=8,
    values=(
        "temperature_2m", "wind_speed_10m", "wind_speed_100m", "shortwave_radiation", "cloud_cover",
    ),
)

REFRESH_MARKS = Table(
    "control", "refresh_marks",
    "name string not null, ingested_until timestamp not null",
    keys=("name",),
)

DIM_DATE = Table(
    "silver", "dim_date",
    "date_id int not null, full_date date not null, year int not null, month int not null, "
    "day_of_month int not null, day_of_week int not null, week_of_year int not null, "
    "quarter int not null, is_weekday boolean not null, is_ro_holiday boolean not null, "
    "season string not null",
    keys=("date_id",),
)
DIM_DATETIME = Table(
    "silver", "dim_datetime",
    "timezone string not null, timestamp_utc timestamp not null, date_id int not null, "
    "interval_of_day int not null, local_time_id int not null, local_hour int not null, "
    "quarter_of_hour int not null, time_label string not null, "
    "utc_offset_minutes int not null, is_dst boolean not null, "
    "is_repeated_hour boolean not null, is_hour_start boolean not null",
    keys=("timezone", "timestamp_utc"),
    partitions=("timezone",), month_of="date_id",
)
DIM_MARKET = Table(
    "silver", "dim_market",
    "market_id string not null, market_name string not null, bidding_zone string not null, "
    "timezone string not null, currency string not null, reporting_currency string not null, "
    "peak_start_hour int not null, peak_end_hour int not null",
    keys=("market_id",),
)
DIM_LOCATION = Table(
    "silver", "dim_location",
    "location_id int not null, location_name string not null, market_id string not null, "
    "latitude double not null, longitude double not null, wind_weight double not null, "
    "solar_weight double not null, demand_weight double not null",
    keys=("market_id", "location_name"),
)
DIM_PRODUCTION_TYPE = Table(
    "silver", "dim_production_type",
    "production_type_id int not null, production_type_name string not null, "
    "energy_category string not null, is_renewable boolean not null, "
    "is_variable boolean not null, is_dispatchable boolean not null",
    keys=("production_type_name",),
)
EXCHANGE_RATES = Table(
    "silver", "exchange_rates",
    "date date not null, base_currency string not null, quote_currency string not null, "
    "rate double not null, source string not null, processed_at timestamp not null",
    keys=("date", "base_currency", "quote_currency"),
    partitions=("base_currency", "quote_currency"),
)
FACT_PRICE = Table(
    "silver", "fact_price",
    "date_id int not null, interval_of_day int not null, timestamp_utc timestamp not null, "
    "local_time_id int not null, market_id string not null, price_local_mwh double, "
    "fx_rate double, price_eur_mwh double",
    keys=("market_id", "timestamp_utc"),
    partitions=("market_id",), month_of="date_id",
)
FACT_GENERATION = Table(
    "silver", "fact_generation",
    "date_id int not null, time_id int not null, hour_start_utc timestamp not null, "
    "market_id string not null, production_type_id int not null, actual_mw double",
    keys=("hour_start_utc", "market_id", "production_type_id"),
    partitions=("market_id",), month_of="date_id",
)
FACT_LOAD = Table(
    "silver", "fact_load",
    "date_id int not null, time_id int not null, hour_start_utc timestamp not null, "
    "market_id string not null, actual_load_mw double",
    keys=("hour_start_utc", "market_id"),
    partitions=("market_id",), month_of="date_id",
)
FACT_WEATHER = Table(
    "silver", "fact_weather",
    "date_id int not null, time_id int not null, hour_start_utc timestamp not null, "
    "location_id int not null, data_type string not null, temperature_c double, "
    "wind_speed_ms double, solar_irradiance_wm2 double, cloud_cover_pct double",
    keys=("hour_start_utc", "location_id", "data_type"),
    partitions=("location_id",), month_of="date_id",
)
PRICE_HOURLY = Table(
    "gold", "price_hourly",
    "date_id int not null, time_id int not null, hour_start_utc timestamp not null, "
    "market_id string not null, price_local_mwh double, fx_rate double, price_eur_mwh double, "
    "is_peak boolean not null, time_label string not null, is_repeated_hour boolean not null",
    keys=("market_id", "hour_start_utc"),
    partitions=("market_id",), month_of="date_id",
)
GENERATION_HOURLY = Table(
    "gold", "generation_hourly",
    "date_id int not null, time_id int not null, hour_start_utc timestamp not null, "
    "market_id string not null, "
    + "".join(f"{column} double not null, " for column in mix_columns().values())
    + "other_discovered_mw double not null, total_mw double, renewable_mw double, "
    "thermal_mw double, nuclear_mw_total double, renewable_share_pct double",
    keys=("market_id", "hour_start_utc"),
    partitions=("market_id",), month_of="date_id",
)
ARBITRAGE_WINDOWS = Table(
    "gold", "arbitrage_windows",
    "date_id int not null, market_id string not null, type string not null, "
    "start_utc timestamp not null, start_time_id int, end_time_id int, start_label string, "
    "end_label string, avg_price_eur_mwh double, n_slots bigint not null, "
    "arbitrage_spread_eur_mwh double",
    keys=("market_id", "start_utc"),
    partitions=("market_id",), month_of="date_id",
)
BESS_SIGNALS = Table(
    "gold", "bess_signals",
    "date_id int not null, time_id int not null, interval_of_day int not null, "
    "timestamp_utc timestamp not null, market_id string not null, time_label string not null, "
    "price_local_mwh double, price_eur_mwh double, price_rank_asc int, price_rank_desc int, "
    "signal int not null, daily_min_price_eur_mwh double, daily_max_price_eur_mwh double, "
    "arbitrage_spread_eur_mwh double",
    keys=("market_id", "timestamp_utc"),
    partitions=("market_id",), month_of="date_id",
)
