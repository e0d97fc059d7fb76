"""Markets and production types: the configuration the tables are built from."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .functions.text import location_id
from .functions.time import Zones


@dataclass(frozen=True)
class Location:
    """Weather point; each kind of weight sums to 1 over a market's points."""

    name: str
    latitude: float
    longitude: float
    wind_weight: float = 0.0
    solar_weight: float = 0.0
    demand_weight: float = 0.0


@dataclass(frozen=True)
class Market:
    """One bidding zone.  The peak block is in local hours, half-open."""

    bidding_zone: str
    timezone: str
    currency: str
    name: str = ""
    reporting_currency: str = "EUR"
    fx_source: str = "BNR"
    locations: tuple[Location, ...] = ()
    peak_start_hour: int = 8
    peak_end_hour: int = 20


# The one market configured today.
MARKETS: dict[str, Market] = {
    "RO": Market(
        bidding_zone="10YRO-TEL------P",
        timezone="Europe/Bucharest",
        currency="RON",
        name="Romania",
        locations=(
            Location("Bucharest", 44.4268, 26.1025, 0.02, 0.22, 0.35),
            Location("Dobrogea", 44.1800, 28.6500, 0.70, 0.18, 0.08),
            Location("Oltenia", 44.3200, 23.8000, 0.02, 0.17, 0.15),
            Location("Transylvania", 46.7712, 23.5938, 0.05, 0.15, 0.20),
            Location("Moldova", 47.1585, 27.5907, 0.11, 0.15, 0.12),
            Location("Banat", 45.7489, 21.2087, 0.10, 0.13, 0.10),
        ),
    ),
}

# Published production types in id order (ids 1 to 21) with
# energy category, renewable, variable and dispatchable flags.
PRODUCTION_TYPES = (
    ("Biomass", "Renewable", True, False, True),
    ("Fossil Brown coal/Lignite", "Thermal", False, False, True),
    ("Fossil Coal-derived gas", "Thermal", False, False, True),
    ("Fossil Gas", "Thermal", False, False, True),
    ("Fossil Hard coal", "Thermal", False, False, True),
    ("Fossil Oil", "Thermal", False, False, True),
    ("Fossil Oil shale", "Thermal", False, False, True),
    ("Fossil Peat", "Thermal", False, False, True),
    ("Geothermal", "Renewable", True, False, False),
    ("Hydro Pumped Storage|Actual Aggregated", "Storage", False, False, True),
    ("Hydro Pumped Storage|Actual Consumption", "Storage", False, False, True),
    ("Hydro Run-of-river and poundage", "Renewable", True, False, False),
    ("Hydro Water Reservoir", "Renewable", True, False, True),
    ("Marine", "Renewable", True, True, False),
    ("Nuclear", "Nuclear", False, False, True),
    ("Other", "Other", False, False, False),
    ("Other renewable", "Renewable", True, False, False),
    ("Solar", "Renewable", True, True, False),
    ("Waste", "Thermal", False, False, True),
    ("Wind Offshore", "Renewable", True, True, False),
    ("Wind Onshore", "Renewable", True, True, False),
)

_MARKET_COLUMNS = (
    "market_id string, market_name string, bidding_zone string, timezone string, "
    "currency string, reporting_currency string, fx_source string, "
    "peak_start_hour int, peak_end_hour int, "
    "locations array<struct<name: string, latitude: double, longitude: double, "
    "wind_weight: double, solar_weight: double, demand_weight: double>>"
)
_TYPE_COLUMNS = (
    "production_type_id int, production_type_name string, energy_category string, "
    "is_renewable boolean, is_variable boolean, is_dispatchable boolean"
)


def small_frame(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A frame of literal rows whose size the optimizer knows.

    Built from Arrow it becomes a local relation, while a list of tuples would be
    an RDD of unknown size, which keeps Spark from planning broadcast joins.
    """
    schema = StructType.fromDDL(columns)
    entries = [dict(zip(schema.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(entries, to_arrow_schema(schema)), schema)


def get_market(market_id: str, markets: Mapping[str, Market] = MARKETS) -> Market:
    if market_id not in markets:
        raise ValueError(f"Unknown market {market_id!r}; configured: {sorted(markets)}")
    return markets[market_id]


def markets_frame(spark: SparkSession, markets: Mapping[str, Market] = MARKETS) -> DataFrame:
    """The registry as rows, one per market.  Its size is the size of the config."""
    rows = [
        (
            market_id, m.name or market_id, m.bidding_zone, m.timezone, m.currency,
            m.reporting_currency, m.fx_source, m.peak_start_hour, m.peak_end_hour,
            [asdict(p) for p in m.locations],
        )
        for market_id, m in markets.items()
    ]
    return small_frame(spark, rows, _MARKET_COLUMNS)


def zones(markets: Mapping[str, Market], column: str = "timezone") -> Zones:
    """The zone column of rows joined with the registry, and the zones it can hold."""
    return Zones(column, tuple(sorted({m.timezone for m in markets.values()})))


def locations_frame(markets: DataFrame) -> DataFrame:
    """One row per weather point of ``markets_frame``."""
    return markets.select("market_id", F.inline("locations")).select(
        location_id("market_id", "name").alias("location_id"),
        F.col("name").alias("location_name"), "market_id", "latitude", "longitude",
        "wind_weight", "solar_weight", "demand_weight",
    )


def production_types_frame(spark: SparkSession, types: tuple = PRODUCTION_TYPES) -> DataFrame:
    """Published types with their fixed ids."""
    rows = [(position, *entry) for position, entry in enumerate(types, start=1)]
    return small_frame(spark, rows, _TYPE_COLUMNS)


def mix_columns(types: tuple = PRODUCTION_TYPES) -> dict[str, str]:
    """Output column per production type, by the same rule as ``text.megawatt_column``."""
    names = [entry[0] for entry in types]
    words = ["".join(c if c.isascii() and c.isalnum() else " " for c in n.lower()) for n in names]
    return {name: "_".join(w.split()) + "_mw" for name, w in zip(names, words)}


def required_pairs(markets: DataFrame) -> DataFrame:
    """Currency pairs the markets need, with the source that leads for each.

    A market that settles in its reporting currency gets SYNTHETIC whatever its
    configured source.  The central-bank source falls back on the ECB.
    """
    lead = F.when(F.col("currency") == F.col("reporting_currency"), "SYNTHETIC").otherwise(
        F.col("fx_source")
    )
    return markets.select(
        F.col("reporting_currency").alias("base_currency"),
        F.col("currency").alias("quote_currency"),
        lead.alias("primary_source"),
        F.when(lead == "BNR", "ECB").alias("secondary_source"),
    ).distinct()


def market_timezones(markets: DataFrame) -> DataFrame:
    return markets.select("timezone").distinct()
