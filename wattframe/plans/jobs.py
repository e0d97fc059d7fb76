"""Jobs: read stored tables or landing files, build, store.

Every job takes a base folder and an inclusive date range of any length; one run
covers it.  ``market_id=None`` means all configured markets in that one run.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.time import date_id_of
from ..operators.quality import coverage
from ..operators.rank import CHARGE_SLOTS, DISCHARGE_SLOTS
from ..operators.staging import stored
from ..operators.store import (
    TableNotFound,
    merge_upsert,
    read_table,
    replace_date_range,
)
from ..registry import MARKETS, get_market, markets_frame, production_types_frame
from ..schemas import Table, conform
from ..sources import landing, prices, rates, series
from . import bronze, dims, gold, queries, silver
from .silver import Markets


def _selected(market_id: str | None, markets: Markets) -> Markets:
    return markets if market_id is None else {market_id: get_market(market_id, markets)}


def _stored(
    spark: SparkSession, base: str, table: Table, filters: list | None = None, optional: bool = False
) -> DataFrame:
    try:
        return read_table(spark, table.path(base), filters or [], table.schema, table.month_of)
    except TableNotFound:
        if optional:
            return spark.createDataFrame([], table.schema)
        raise


def _market_filter(market_id: str | None) -> list:
    return [] if market_id is None else [("market_id", "=", market_id)]


def _instants(start: date, end: date, ts: str = "timestamp_utc") -> list:
    """Span of instants that contains the local days of any zone."""
    midnight = datetime.min.time()
    return [
        (ts, ">=", datetime.combine(start - timedelta(days=1), midnight)),
        (ts, "<", datetime.combine(end + timedelta(days=2), midnight)),
    ]


# ---- landing to Bronze -------------------------------------------------------


class Ingested(NamedTuple):
    """What an ingest run did: rows appended, status of every day asked for, and what was left out.

    ``rejected`` lists refused days, ``malformed`` counts dropped rows; sources
    whose files have no such rules give None.
    """

    rows: int
    coverage: DataFrame
    rejected: DataFrame | None = None
    malformed: DataFrame | None = None


def _append(
    df: DataFrame, base: str, table: Table, prune: str, ingested_at: datetime | None, compare: str,
) -> int:
    """Append a parsed batch, which is stored once, so that its files are parsed once."""
    stamp = ingested_at or datetime.now(timezone.utc).replace(tzinfo=None)
    rows = conform(df.withColumn("ingested_at", F.lit(stamp).cast("timestamp")), table)
    return bronze.append(stored(rows, table.name), table, base, prune, compare)


def _files(
    spark: SparkSession, landing_base: str, layout: str, market_id: str | None, start: date, end: date,
    **options: str,
) -> DataFrame:
    folders = {} if market_id is None else {"market_id": market_id}
    return landing.read_files(spark, landing_base, layout, start, end, **options, **folders)


def _coverage(
    files: DataFrame, source: str, market_id: str | None, markets: Markets, start: date, end: date,
    refused: DataFrame | None = None,
) -> DataFrame:
    """fetched, failed (refused) or missing for every market and day of the range."""
    spark, on = files.sparkSession, ["market_id", "date"]
    expected = markets_frame(spark, _selected(market_id, markets)).select(
        "market_id", F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date")
    )
    found = files.select(landing.path_market(source).alias("market_id"), landing.file_date().alias("date"))
    if refused is None:
        return coverage(expected, found.distinct().withColumn("status", F.lit("fetched")), on)
    bad = refused.select("market_id", F.col("delivery_date").alias("date")).distinct()
    good = found.distinct().join(bad, on, "left_anti").withColumn("status", F.lit("fetched"))
    return coverage(expected, good.unionByName(bad.withColumn("status", F.lit("failed"))), on)


def ingest_prices(
    spark: SparkSession, landing_base: str, base: str, market_id: str | None, start: date, end: date,
    ingested_at: datetime | None = None, compare: str = "any", markets: Markets = MARKETS,
) -> Ingested:
    """Append day-ahead prices of one market, or of all."""
    files = _files(spark, landing_base, landing.OPCOM_PRICES, market_id, start, end)
    days = stored(prices.parse_price_files(files), "price-days")
    rejected = prices.rejected_days(days)
    rows = _append(
        prices.accepted_prices(days), base, schemas.OPCOM_PRICES, "delivery_date", ingested_at, compare
    )
    known = _coverage(files, "opcom_pzu", market_id, markets, start, end, rejected)
    return Ingested(rows, known, rejected, prices.malformed_counts(days))


def ingest_generation_and_load(
    spark: SparkSession, landing_base: str, base: str, market_id: str | None, start: date, end: date,
    ingested_at: datetime | None = None, compare: str = "any", markets: Markets = MARKETS,
) -> tuple[Ingested, Ingested]:
    """Append generation and load; the outcome of each."""
    jobs = (
        (landing.ENTSOE_GENERATION, series.parse_generation, schemas.ENTSOE_GENERATION),
        (landing.ENTSOE_LOAD, series.parse_load, schemas.ENTSOE_LOAD),
    )
    done = []
    for layout, parse, table in jobs:
        files = _files(spark, landing_base, layout, market_id, start, end)
        rows = _append(parse(files), base, table, "timestamp_utc", ingested_at, compare)
        done.append(Ingested(rows, _coverage(files, "entsoe", market_id, markets, start, end)))
    return done[0], done[1]


def ingest_weather(
    spark: SparkSession, landing_base: str, base: str, market_id: str | None, start: date, end: date,
    ingested_at: datetime | None = None, compare: str = "any", markets: Markets = MARKETS,
) -> Ingested:
    files = _files(spark, landing_base, landing.WEATHER, market_id, start, end)
    rows = _append(
        series.parse_weather(files), base, schemas.WEATHER, "timestamp_utc", ingested_at, compare
    )
    return Ingested(rows, _coverage(files, "weather", market_id, markets, start, end))


def _days_covered(files: DataFrame, start: date, end: date) -> DataFrame:
    """fetched or missing for every day of the range; banks publish none on days off."""
    spark = files.sparkSession
    expected = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))
    found = files.select(landing.file_date().alias("date")).distinct()
    return coverage(expected, found.withColumn("status", F.lit("fetched")), ["date"])


def ingest_bnr_rates(
    spark: SparkSession, landing_base: str, base: str, start: date, end: date,
    ingested_at: datetime | None = None, compare: str = "any",
) -> Ingested:
    """Append the central bank's rates."""
    files = landing.read_files(spark, landing_base, landing.BNR_RATES, start, end, suffix=".xml")
    notes = landing.read_files(spark, landing_base, landing.BNR_RATES, start, end, suffix=".json")
    rows = _append(rates.parse_bnr(files, notes), base, schemas.BNR_RATES, "date", ingested_at, compare)
    return Ingested(rows, _days_covered(files, start, end))


def ingest_ecb_rates(
    spark: SparkSession, landing_base: str, base: str, start: date, end: date,
    ingested_at: datetime | None = None, compare: str = "any",
) -> Ingested:
    """Append the ECB's rates."""
    files = landing.read_files(spark, landing_base, landing.ECB_RATES, start, end, suffix=".json")
    rows = _append(rates.parse_ecb(files), base, schemas.ECB_RATES, "date", ingested_at, compare)
    return Ingested(rows, _days_covered(files, start, end))


# ---- dimensions ----------------------------------------------------------------


class Built(NamedTuple):
    """What a build did: rows written, and how many input rows it left out, by reason."""

    rows: int
    dropped: DataFrame


def _upsert(
    df: DataFrame, base: str, table: Table, key_fixes_partition: bool = True, settled: bool = False
) -> int:
    return merge_upsert(
        df.sparkSession, conform(df, table), table.path(base), table.keys, table.partitions,
        key_fixes_partition, table.month_of, settled,
    )


def _built(marked: DataFrame, base: str, table: Table) -> Built:
    """Store a marked frame once, the fact from it, and count what stays out of the fact."""
    once = stored(marked, f"marked-{table.name}")
    return Built(_upsert(silver.kept(once), base, table, settled=True), silver.dropped(once, table.name))


def build_dim_date(spark: SparkSession, base: str, start: date, end: date) -> int:
    days = dims.date_spine(dims.date_bounds(spark, start, end))
    return _upsert(dims.dim_date(days), base, schemas.DIM_DATE)


def build_dim_datetime(
    spark: SparkSession, base: str, start: date, end: date, markets: Markets = MARKETS
) -> int:
    axis = dims.dim_datetime(markets_frame(spark, markets), start, end)
    return _upsert(axis, base, schemas.DIM_DATETIME)


def build_registry_dims(spark: SparkSession, base: str, markets: Markets = MARKETS) -> None:
    """dim_market and dim_location."""
    registry = markets_frame(spark, markets)
    _upsert(dims.dim_market(registry), base, schemas.DIM_MARKET)
    _upsert(dims.dim_location(registry), base, schemas.DIM_LOCATION)


def build_dim_production_type(
    spark: SparkSession, base: str, start: date | None = None, end: date | None = None
) -> int:
    """Add newly discovered types; earlier ones stay as they are.

    With a date range only its readings are searched, which suffices for a run
    that builds facts for that range.
    """
    span = _instants(start, end) if start and end else []
    seen = _stored(spark, base, schemas.ENTSOE_GENERATION, span, optional=True)
    assigned = _stored(spark, base, schemas.DIM_PRODUCTION_TYPE, optional=True)
    types = dims.dim_production_type(production_types_frame(spark), seen, assigned)
    return _upsert(types, base, schemas.DIM_PRODUCTION_TYPE)


# ---- Bronze to Silver ------------------------------------------------------------


def build_exchange_rates(
    spark: SparkSession, base: str, start: date, end: date, markets: Markets = MARKETS,
    processed_at: datetime | None = None,
) -> int:
    """A source without a table counts as having published nothing."""
    span = [("date", "<=", end)]
    daily = silver.exchange_rates(
        _stored(spark, base, schemas.BNR_RATES, span, optional=True),
        _stored(spark, base, schemas.ECB_RATES, span, optional=True),
        markets, start, end,
    )
    stamp = processed_at or datetime.now(timezone.utc).replace(tzinfo=None)
    stamped = daily.withColumn("processed_at", F.lit(stamp).cast("timestamp"))
    return _upsert(stamped, base, schemas.EXCHANGE_RATES)


def build_fact_price(
    spark: SparkSession, base: str, market_id: str | None, start: date, end: date,
    markets: Markets = MARKETS,
) -> Built:
    days = [("delivery_date", ">=", start), ("delivery_date", "<=", end)]
    observed = _stored(spark, base, schemas.OPCOM_PRICES, _market_filter(market_id) + days)
    rates = _stored(spark, base, schemas.EXCHANGE_RATES, [("date", ">=", start), ("date", "<=", end)])
    marked = silver.marked_prices(observed, rates, _selected(market_id, markets), start, end)
    return _built(marked, base, schemas.FACT_PRICE)


def build_fact_generation(
    spark: SparkSession, base: str, market_id: str | None, start: date, end: date,
    markets: Markets = MARKETS,
) -> Built:
    source = _market_filter(market_id) + _instants(start, end)
    observed = _stored(spark, base, schemas.ENTSOE_GENERATION, source)
    types = _stored(spark, base, schemas.DIM_PRODUCTION_TYPE)
    marked = silver.marked_generation(observed, types, _selected(market_id, markets), start, end)
    return _built(marked, base, schemas.FACT_GENERATION)


def build_fact_load(
    spark: SparkSession, base: str, market_id: str | None, start: date, end: date,
    markets: Markets = MARKETS,
) -> int:
    source = _market_filter(market_id) + _instants(start, end)
    load = _stored(spark, base, schemas.ENTSOE_LOAD, source)
    fact = silver.fact_load(load, _selected(market_id, markets), start, end)
    return _upsert(fact, base, schemas.FACT_LOAD)


def build_fact_weather(
    spark: SparkSession, base: str, market_id: str | None, start: date, end: date,
    markets: Markets = MARKETS,
) -> Built:
    source = _market_filter(market_id) + _instants(start, end)
    observed = _stored(spark, base, schemas.WEATHER, source)
    places = _stored(spark, base, schemas.DIM_LOCATION)
    marked = silver.marked_weather(observed, places, _selected(market_id, markets), start, end)
    return _built(marked, base, schemas.FACT_WEATHER)


# ---- Silver to Gold --------------------------------------------------------------


def _days(market_id: str | None, start: date, end: date, markets: Markets) -> list:
    return [
        ("market_id", "in", list(_selected(market_id, markets))),
        ("date_id", ">=", date_id_of(start)),
        ("date_id", "<=", date_id_of(end)),
    ]


def _replace(
    df: DataFrame, base: str, table: Table, market_id: str | None, start: date, end: date,
    markets: Markets,
) -> int:
    return replace_date_range(
        df.sparkSession, conform(df, table), table.path(base), _selected(market_id, markets),
        date_id_of(start), date_id_of(end),
    )


def build_price_hourly(
    spark: SparkSession, base: str, market_id: str | None, start: date, end: date,
    markets: Markets = MARKETS,
) -> int:
    facts = _stored(spark, base, schemas.FACT_PRICE, _days(market_id, start, end, markets))
    hourly = gold.price_hourly(facts, _selected(market_id, markets))
    return _replace(hourly, base, schemas.PRICE_HOURLY, market_id, start, end, markets)


def build_generation_hourly(
    spark: SparkSession, base: str, market_id: str | None, start: date, end: date,
    markets: Markets = MARKETS,
) -> int:
    facts = _stored(spark, base, schemas.FACT_GENERATION, _days(market_id, start, end, markets))
    wide = gold.generation_hourly(facts, _stored(spark, base, schemas.DIM_PRODUCTION_TYPE))
    return _replace(wide, base, schemas.GENERATION_HOURLY, market_id, start, end, markets)


def build_bess_signals(
    spark: SparkSession, base: str, market_id: str | None, start: date, end: date,
    charge_slots: int = CHARGE_SLOTS, discharge_slots: int = DISCHARGE_SLOTS,
    markets: Markets = MARKETS,
) -> int:
    facts = _stored(spark, base, schemas.FACT_PRICE, _days(market_id, start, end, markets))
    marked = gold.bess_signals(facts, _selected(market_id, markets), charge_slots, discharge_slots)
    return _replace(marked, base, schemas.BESS_SIGNALS, market_id, start, end, markets)


def build_arbitrage_windows(
    spark: SparkSession, base: str, market_id: str | None, start: date, end: date,
    markets: Markets = MARKETS,
) -> int:
    marked = _stored(spark, base, schemas.BESS_SIGNALS, _days(market_id, start, end, markets))
    windows = queries.arbitrage_windows(marked)
    return _replace(windows, base, schemas.ARBITRAGE_WINDOWS, market_id, start, end, markets)


def build_all(
    spark: SparkSession, base: str, start: date, end: date, markets: Markets = MARKETS
) -> None:
    """Dimensions, Silver and Gold for a date range, in dependency order."""
    build_dim_date(spark, base, start, end)
    build_dim_datetime(spark, base, start, end, markets)
    build_registry_dims(spark, base, markets)
    build_dim_production_type(spark, base, start, end)
    build_exchange_rates(spark, base, start, end, markets)
    build_fact_price(spark, base, None, start, end, markets)
    build_fact_generation(spark, base, None, start, end, markets)
    build_fact_load(spark, base, None, start, end, markets)
    build_fact_weather(spark, base, None, start, end, markets)
    build_price_hourly(spark, base, None, start, end, markets)
    build_generation_hourly(spark, base, None, start, end, markets)
    build_bess_signals(spark, base, None, start, end, markets=markets)
    build_arbitrage_windows(spark, base, None, start, end, markets)
