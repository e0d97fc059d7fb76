"""Rebuild of the days that newly ingested observations touch, and of nothing else.

What a run has to do follows from the data and not from the caller's guess of a range: observations ingested since the
mark of the last run give a set of (market, local day), which every job below them is narrowed to by a semi join.
The months of the set are literals, so that no other month is opened.  A new exchange rate touches the days whose
carried-forward rate it changes.  Marks move only at the end; a run that breaks off is repeated, and a repeated
run writes the same rows.

An observation must be ingested with a later ``ingested_at`` than the mark, or its day is not found; the jobs' own stamps are.
"""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import time as ft
from ..operators.rank import CHARGE_SLOTS, DISCHARGE_SLOTS
from ..operators.staging import stored
from ..operators.store import MONTH, month_column, replace_days
from ..registry import MARKETS, markets_frame, zones
from ..schemas import Table, conform
from . import gold, queries, silver
from .jobs import _stored, _upsert, build_dim_production_type, build_registry_dims
from .silver import Markets, with_market


class _Arrivals:
    """Observations ingested since the marks of the last run, and the marks of this one."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        self.seen = {r.name: r.ingested_until for r in _stored(spark, base, schemas.REFRESH_MARKS, optional=True).collect()}
        self.until: dict[str, datetime] = {}

    def of(self, table: Table) -> DataFrame:
        """New rows of ``table``, up to the latest one there is now."""
        rows = _stored(self.spark, self.base, table, optional=True)
        if table.name in self.seen:
            rows = rows.filter(F.col("ingested_at") > F.lit(self.seen[table.name]))
        last = rows.agg(F.max("ingested_at")).first()[0]
        if last is None:
            return rows.limit(0)
        self.until[table.name] = last
        return rows.filter(F.col("ingested_at") <= F.lit(last))

    def done(self) -> None:
        marks = self.spark.createDataFrame(list(self.until.items()), schemas.REFRESH_MARKS.schema)
        if self.until:
            _upsert(marks, self.base, schemas.REFRESH_MARKS)


def local_day(df: DataFrame, markets: Markets, ts: str) -> DataFrame:
    """Add ``day``, the market's local day of an instant."""
    zoned = with_market(df, markets, "timezone")
    return zoned.withColumn("day", F.to_date(ft.local_time(ts, zones(markets)))).drop("timezone")


def changed_rates(
    spark: SparkSession, base: str, arrivals: _Arrivals, markets: Markets, start: date, end: date
) -> DataFrame:
    """Days and pairs whose rate differs from the stored one, from the first new quotation on."""
    firsts = [arrivals.of(t).agg(F.min("date")).first()[0] for t in (schemas.BNR_RATES, schemas.ECB_RATES)]
    known = [d for d in firsts if d is not None]
    if not known:
        return spark.createDataFrame([], schemas.EXCHANGE_RATES.schema).drop("processed_at")
    begin, span = max(min(known), start), [("date", "<=", end)]
    daily = silver.exchange_rates(
        *[_stored(spark, base, t, span, optional=True) for t in (schemas.BNR_RATES, schemas.ECB_RATES)],
        markets, begin, end,
    )
    before = _stored(spark, base, schemas.EXCHANGE_RATES, [("date", ">=", begin)], optional=True)
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in daily.columns]
    return daily.alias("n").join(before.alias("o"), reduce(lambda a, b: a & b, same), "left_anti")


def refresh(
    spark: SparkSession, base: str, start: date, end: date, markets: Markets = MARKETS,
    charge_slots: int = CHARGE_SLOTS, discharge_slots: int = DISCHARGE_SLOTS, processed_at: datetime | None = None,
) -> dict[str, int]:
    """Bring Silver and Gold of [start, end] up to date with Bronze; rows written by table, untouched tables left out.

    The outcome equals that of ``jobs.build_all`` over [start, end]; the first run builds everything.
    """
    arrivals, written = _Arrivals(spark, base), {}
    build_registry_dims(spark, base, markets)

    rates = stored(changed_rates(spark, base, arrivals, markets, start, end), "changed-rates")
    if not rates.isEmpty():
        stamp = F.lit(processed_at) if processed_at else F.current_timestamp()
        written["exchange_rates"] = _upsert(rates.withColumn("processed_at", stamp), base, schemas.EXCHANGE_RATES)
    pairs = markets_frame(spark, markets).select(
        "market_id", F.col("reporting_currency").alias("base_currency"), F.col("currency").alias("quote_currency")
    )
    priced = arrivals.of(schemas.OPCOM_PRICES).select("market_id", F.col("delivery_date").alias("day"))
    revalued = rates.join(pairs, ["base_currency", "quote_currency"]).select("market_id", F.col("date").alias("day"))
    written |= _prices(spark, base, _days(priced.unionByName(revalued), start, end), markets, charge_slots, discharge_slots)

    for table, build in ((schemas.ENTSOE_GENERATION, _generation), (schemas.ENTSOE_LOAD, _load), (schemas.WEATHER, _weather)):
        days = _days(local_day(arrivals.of(table), markets, "timestamp_utc"), start, end)
        written |= build(spark, base, days, markets)
    arrivals.done()
    return written


class _Days:
    """A set of (market, local day): the frame, its bounds, and the months that its rows can lie in."""

    def __init__(self, frame: DataFrame):
        self.frame = frame
        around = F.explode(F.array(F.date_sub("day", 1), F.col("day"), F.date_add("day", 1)))
        months = frame.select("day", month_column("day", frame.schema["day"].dataType).alias("own"), around.alias("near"))
        found = months.agg(
            F.min("day").alias("first"), F.max("day").alias("last"), F.collect_set("own").alias("own"),
            F.collect_set(month_column("near", frame.schema["day"].dataType)).alias("near"),
        ).first()
        self.first, self.last, self.months, self.months_around = found.first, found.last, sorted(found.own), sorted(found.near)

    def __bool__(self) -> bool:
        return self.first is not None

    def observations(self, spark: SparkSession, base: str, table: Table, markets: Markets, ts: str | None = None) -> DataFrame:
        """Rows of ``table`` on these days."""
        months = self.months if ts is None else self.months_around
        rows = _stored(spark, base, table, [(MONTH, "in", months)])
        dated = rows.withColumn("day", F.col("delivery_date")) if ts is None else local_day(rows, markets, ts)
        return dated.join(self.frame, ["market_id", "day"], "left_semi").drop("day")

    def facts(self, spark: SparkSession, base: str, table: Table) -> DataFrame:
        rows = _stored(spark, base, table, [(MONTH, "in", self.months)])
        return rows.join(self.ids(), ["market_id", "date_id"], "left_semi")

    def ids(self) -> DataFrame:
        return self.frame.select("market_id", ft.date_id("day").alias("date_id"))

    def replace(self, df: DataFrame, base: str, table: Table) -> dict[str, int]:
        rows = replace_days(
            df.sparkSession, conform(df, table), table.path(base), self.ids(), partitions=table.partitions
        )
        return {table.name: rows}


def _days(df: DataFrame, start: date, end: date) -> _Days:
    within = df.filter(F.col("day").between(F.lit(start), F.lit(end))).select("market_id", "day").distinct()
    return _Days(stored(within, "touched-days"))


def _prices(
    spark: SparkSession, base: str, days: _Days, markets: Markets, charge_slots: int, discharge_slots: int
) -> dict[str, int]:
    """fact_price and the three Gold tables that rest on it."""
    if not days:
        return {}
    span = [("date", ">=", days.first), ("date", "<=", days.last)]
    rates = _stored(spark, base, schemas.EXCHANGE_RATES, span, optional=True)
    observed = days.observations(spark, base, schemas.OPCOM_PRICES, markets)
    written = days.replace(
        silver.fact_price(observed, rates, markets, days.first, days.last), base, schemas.FACT_PRICE
    )
    facts = days.facts(spark, base, schemas.FACT_PRICE)
    written |= days.replace(gold.price_hourly(facts, markets), base, schemas.PRICE_HOURLY)
    marked = gold.bess_signals(facts, markets, charge_slots, discharge_slots)
    written |= days.replace(marked, base, schemas.BESS_SIGNALS)
    signals = days.facts(spark, base, schemas.BESS_SIGNALS)
    return written | days.replace(queries.arbitrage_windows(signals), base, schemas.ARBITRAGE_WINDOWS)


def _generation(spark: SparkSession, base: str, days: _Days, markets: Markets) -> dict[str, int]:
    if not days:
        return {}
    build_dim_production_type(spark, base, days.first, days.last)
    types = _stored(spark, base, schemas.DIM_PRODUCTION_TYPE)
    observed = days.observations(spark, base, schemas.ENTSOE_GENERATION, markets, "timestamp_utc")
    fact = silver.fact_generation(observed, types, markets, days.first, days.last)
    written = days.replace(fact, base, schemas.FACT_GENERATION)
    mix = gold.generation_hourly(days.facts(spark, base, schemas.FACT_GENERATION), types)
    return written | days.replace(mix, base, schemas.GENERATION_HOURLY)


def _load(spark: SparkSession, base: str, days: _Days, markets: Markets) -> dict[str, int]:
    if not days:
        return {}
    observed = days.observations(spark, base, schemas.ENTSOE_LOAD, markets, "timestamp_utc")
    return days.replace(silver.fact_load(observed, markets, days.first, days.last), base, schemas.FACT_LOAD)


def _weather(spark: SparkSession, base: str, days: _Days, markets: Markets) -> dict[str, int]:
    """The table has places instead of markets: a day of a market is that day of all its places."""
    if not days:
        return {}
    table, places = schemas.FACT_WEATHER, _stored(spark, base, schemas.DIM_LOCATION)
    observed = days.observations(spark, base, schemas.WEATHER, markets, "timestamp_utc")
    fact = silver.fact_weather(observed, places, markets, days.first, days.last)
    ids = stored(days.ids().join(places.select("market_id", "location_id"), "market_id").drop("market_id"), "touched-places")
    rows = replace_days(
        spark, conform(fact, table), table.path(base), ids, on=("location_id", "date_id"), partitions=table.partitions
    )
    return {table.name: rows}

