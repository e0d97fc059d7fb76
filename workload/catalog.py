"""Named queries: a Spark plan built from library operators, and the SQL it must equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattframe.functions import calendar as cal
from wattframe.functions import money, text
from wattframe.functions import time as ft
from wattframe.operators import bucketed, changes, manifest, quality, resolve, sketches, store, usage, versions
from wattframe.operators.axis import date_spine, join_axis, peak_slot_range, settlement_axis
from wattframe.operators.fill import asof_join, forward_fill
from wattframe.operators.latest import latest_per_key
from wattframe.operators.resample import mean_by
from wattframe.operators.staging import shared_folder, stored
from wattframe.operators.wide import melt
from wattframe.operators.zones import with_offsets, zone_spans
from wattframe.plans import bronze, dims, gold, reports, silver
from wattframe.plans import queries as ask
from wattframe.plans.refresh import refresh
from wattframe.registry import (
    PRODUCTION_TYPES, Market, market_timezones, mix_columns, production_types_frame, required_pairs, small_frame, zones,
)
from wattframe.schemas import ARBITRAGE_WINDOWS, BNR_RATES, ECB_RATES, ENTSOE_GENERATION, OPCOM_PRICES, WEATHER, conform
from wattframe.streaming.ingest import changed_observations, to_folder

from . import frames as fr
from .frames import clock, date_id, instant, local, sql, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL where SQL can say it."""

    def register(build: Query) -> Query:
        name = build.__name__
        QUERIES[name] = lambda spark, sf_dir: fr.zoneless(build(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


# ---- store and revisions -----------------------------------------------------------

_LINEITEM = (
    "l_extendedprice", "l_quantity", "l_partkey", "l_suppkey", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
)


@query(
    f"""SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC, {', '.join(f'{c} DESC' for c in _LINEITEM)}) = 1"""
)
def latest_revision(spark, sf_dir):
    """Newest row per natural key."""
    lines = table(spark, sf_dir, "lineitem")
    return latest_per_key(lines, ["l_orderkey", "l_linenumber"], "l_shipdate", _LINEITEM)


@query(
    sql(
        """SELECT * FROM price_obs QUALIFY row_number() OVER (PARTITION BY market_id, delivery_date, interval_15min
  ORDER BY price_lei_mwh DESC NULLS LAST, volume_mw DESC, volume_buy_mw DESC, volume_sell_mw DESC, ingested_at DESC) = 1""",
        "price_obs",
    )
)
def latest_of_one_run(spark, sf_dir):
    """Newest row per key where one run stored several: the values decide."""
    rows = fr.price_obs(spark, sf_dir).withColumnRenamed("ingested_at", "seen_at")
    stored = rows.withColumn("ingested_at", F.lit(datetime(2026, 1, 1)))
    by = (*OPCOM_PRICES.values, "seen_at")
    return latest_per_key(stored, OPCOM_PRICES.keys, tiebreak=by).drop("ingested_at").withColumnRenamed(
        "seen_at", "ingested_at"
    )


_CUTOFF = date(1998, 1, 1)


@query(
    sql(
        """SELECT * FROM price_obs i WHERE NOT EXISTS (
  SELECT 1 FROM price_obs h WHERE h.delivery_date < DATE '1998-01-01'
    AND h.market_id = i.market_id AND h.delivery_date = i.delivery_date
    AND h.interval_15min = i.interval_15min
    AND h.price_lei_mwh IS NOT DISTINCT FROM i.price_lei_mwh
    AND h.volume_mw = i.volume_mw AND h.volume_buy_mw = i.volume_buy_mw
    AND h.volume_sell_mw = i.volume_sell_mw)""",
        "price_obs",
    )
)
def append_new_obs(spark, sf_dir):
    """Observations that the stored history does not hold yet; NULL equals NULL."""
    incoming = fr.price_obs(spark, sf_dir)
    history = incoming.filter(F.col("delivery_date") < F.lit(_CUTOFF))
    return changes.new_observations(incoming, history, OPCOM_PRICES.keys, OPCOM_PRICES.values)


@query(ORACLES["append_new_obs"])
def append_to_buckets(spark, sf_dir):
    """The same against a history stored in buckets by two runs, which is not exchanged."""
    incoming = fr.price_obs(spark, sf_dir)
    path = f"{shared_folder(spark).rstrip('/')}/buckets-{uuid.uuid4().hex}/prices"
    place = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    layout = {"keys": OPCOM_PRICES.keys, "buckets": OPCOM_PRICES.buckets, "month_of": "delivery_date"}
    for until in (date(1996, 3, 1), _CUTOFF):
        batch = incoming.filter(F.col("delivery_date") < F.lit(until))
        bucketed.append_to_buckets(spark, batch, path, values=OPCOM_PRICES.values, **layout)
    history = bucketed.read_buckets(spark, path, incoming.schema, **layout)
    return bucketed.new_in_buckets(incoming, history, OPCOM_PRICES.keys, OPCOM_PRICES.values)


@query(
    sql(
        """SELECT i.* FROM price_obs i LEFT JOIN price_latest h
  ON h.market_id = i.market_id AND h.delivery_date = i.delivery_date AND h.interval_15min = i.interval_15min
WHERE i.price_lei_mwh IS DISTINCT FROM h.price_lei_mwh OR i.volume_mw IS DISTINCT FROM h.volume_mw
  OR i.volume_buy_mw IS DISTINCT FROM h.volume_buy_mw OR i.volume_sell_mw IS DISTINCT FROM h.volume_sell_mw""",
        "price_latest",
    )
)
def append_vs_latest(spark, sf_dir):
    """Observations that differ from the current revision of their key."""
    rows = fr.price_obs(spark, sf_dir)
    return changes.new_observations(rows, rows, OPCOM_PRICES.keys, OPCOM_PRICES.values, "latest")


@query(
    """SELECT event_id, user_id, event_type, ts FROM events
QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type"""
)
def stream_of_changes(spark, sf_dir):
    """Events that change their user's last type, from a stream that is stopped and goes on between two batches."""
    base = f"{shared_folder(spark).rstrip('/')}/changes-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(base)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    for batch in (events.filter(F.col("ts") < F.lit(_SINCE)), events.filter(F.col("ts") >= F.lit(_SINCE))):
        batch.write.mode("append").parquet(f"{base}/in")
        arriving = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        changes_ = changed_observations(arriving, ["user_id"], ["event_type"], "ts", ["event_id"], timedelta(days=60))
        to_folder(changes_, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{base}/out")


@query(
    sql(
        """, src AS (SELECT market_id, delivery_date, interval_15min, price_lei_mwh + 1 AS price_lei_mwh
  FROM price_latest WHERE delivery_date >= DATE '1998-01-01'),
tgt AS (SELECT market_id, delivery_date, interval_15min, price_lei_mwh
  FROM price_latest WHERE delivery_date < DATE '2000-01-01')
SELECT * FROM src UNION ALL SELECT * FROM tgt t WHERE NOT EXISTS (SELECT 1 FROM src s
  WHERE s.market_id = t.market_id AND s.delivery_date = t.delivery_date AND s.interval_15min = t.interval_15min)""",
        "price_latest",
    )
)
def upsert_rows(spark, sf_dir):
    """Contents of a keyed table after an overlapping batch is merged."""
    rows = latest_per_key(fr.price_obs(spark, sf_dir), OPCOM_PRICES.keys).select(
        *OPCOM_PRICES.keys, "price_lei_mwh"
    )
    target = rows.filter(F.col("delivery_date") < F.lit(date(2000, 1, 1)))
    source = rows.filter(F.col("delivery_date") >= F.lit(_CUTOFF)).withColumn(
        "price_lei_mwh", F.col("price_lei_mwh") + 1
    )
    return changes.merged_rows(target, source, OPCOM_PRICES.keys)


@query(
    sql(
        f""", r AS (SELECT market_id, {date_id('delivery_date')} AS date_id, delivery_date, interval_15min, price_lei_mwh FROM price_latest),
merged AS (SELECT * FROM r WHERE date_id < 19980110 UNION ALL
  SELECT * REPLACE (price_lei_mwh + 1 AS price_lei_mwh) FROM r WHERE date_id >= 19980110)
SELECT * FROM (SELECT * FROM merged WHERE NOT (market_id = 'RO' AND date_id BETWEEN 19970112 AND 19971220)
  UNION ALL SELECT * REPLACE (price_lei_mwh * 2 AS price_lei_mwh) FROM r
  WHERE market_id = 'RO' AND date_id BETWEEN 19970112 AND 19970614)
WHERE market_id IN ('RO', 'GB') AND date_id >= 19960307""",
        "price_latest",
    )
)
def store_round_trip(spark, sf_dir):
    """A table of months written, upserted, replaced from day to day and read back with filters."""
    rows = latest_per_key(fr.price_obs(spark, sf_dir), OPCOM_PRICES.keys).select(
        "market_id", ft.date_id("delivery_date").alias("date_id"), "delivery_date", "interval_15min", "price_lei_mwh"
    )
    path = f"{shared_folder(spark).rstrip('/')}/round-trip-{uuid.uuid4().hex}/prices"
    place = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    price = F.col("price_lei_mwh")
    later = rows.filter("date_id >= 19980110").withColumn("price_lei_mwh", price + 1)
    for batch in (rows.filter("date_id < 19990120"), later):
        store.merge_upsert(
            spark, batch, path, OPCOM_PRICES.keys, ["market_id"], key_fixes_partition=True, month_of="date_id"
        )
    half = rows.filter("market_id = 'RO' AND date_id BETWEEN 19970112 AND 19970614")
    store.replace_date_range(spark, half.withColumn("price_lei_mwh", price * 2), path, "RO", 19970112, 19971220)
    filters = [("market_id", "in", ["RO", "GB"]), ("date_id", ">=", 19960307)]
    return store.read_table(spark, path, filters, rows.schema, "date_id").select(rows.columns)


@query(
    sql(
        f""", r AS (SELECT market_id, {date_id('delivery_date')} AS date_id, price_lei_mwh FROM price_latest)
SELECT 'write' AS step, count(*) AS "rows" FROM r WHERE date_id < 19990120
UNION ALL SELECT 'upsert', count(*) FROM r WHERE date_id >= 19980110
UNION ALL SELECT 'replace', count(*) FROM r WHERE market_id = 'RO' AND date_id BETWEEN 19970112 AND 19970614
UNION ALL SELECT 'append', count(*) FROM r WHERE date_id < 19960307 OR date_id >= 19980110""",
        "price_latest",
    )
)
def rows_written(spark, sf_dir):
    """What every writer says it has written, counted in the writing pass."""
    rows = latest_per_key(fr.price_obs(spark, sf_dir), OPCOM_PRICES.keys).select(
        "market_id", ft.date_id("delivery_date").alias("date_id"), "delivery_date", "interval_15min", "price_lei_mwh"
    )
    base = f"{shared_folder(spark).rstrip('/')}/written-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(base)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    path, options = f"{base}/prices", {"partitions": ["market_id"], "month_of": "date_id"}
    early, late = rows.filter("date_id < 19990120"), rows.filter("date_id >= 19980110")
    upsert = lambda df: store.merge_upsert(spark, df, path, OPCOM_PRICES.keys, key_fixes_partition=True, **options)
    counts = [("write", upsert(early)), ("upsert", upsert(late))]
    half = rows.filter("market_id = 'RO' AND date_id BETWEEN 19970112 AND 19970614")
    counts.append(("replace", store.replace_date_range(spark, half, path, "RO", 19970112, 19971220)))
    bronze_path, known = f"{base}/bronze", {"keys": OPCOM_PRICES.keys, "values": ["price_lei_mwh"], "month_of": "delivery_date"}
    middle = rows.filter("date_id >= 19960307 AND date_id < 19980110")
    store.append_new_observations(spark, middle, bronze_path, **known)
    counts.append(("append", store.append_new_observations(spark, rows, bronze_path, prune="delivery_date", **known)))
    return small_frame(spark, counts, "step string, rows long")


@query(
    sql(
        """SELECT * FROM fact_price WHERE NOT (market_id = 'RO' AND date_id BETWEEN 19970101 AND 19991231)
UNION ALL SELECT * REPLACE (price_local_mwh * 2 AS price_local_mwh) FROM fact_price
WHERE market_id = 'RO' AND date_id BETWEEN 19970101 AND 19981231""",
        "fact_price",
    )
)
def replace_range(spark, sf_dir):
    """Three years of one market replaced by two: the third year becomes empty."""
    facts = stored(fr.fact_price(spark, sf_dir), "facts")  # read twice below
    incoming = facts.filter(changes.in_range("RO", 19970101, 19981231)).withColumn(
        "price_local_mwh", F.col("price_local_mwh") * 2
    )
    return changes.replaced_range(facts, incoming, "RO", 19970101, 19991231)


# ---- time axis -----------------------------------------------------------------------


@query(
    sql(
        f"""SELECT timezone, timestamp_utc, {date_id('date')} AS date_id, CAST(slot AS INTEGER) AS interval_of_day,
  {clock('loc')} AS local_time_id, CAST(hour(loc) AS INTEGER) AS local_hour,
  CAST(minute(loc) // 15 AS INTEGER) AS quarter_of_hour, strftime(loc, '%H:%M') AS time_label,
  CAST(utc_offset AS INTEGER) AS utc_offset_minutes, utc_offset > standard AS is_dst,
  repeated AS is_repeated_hour, minute(loc) = 0 AS is_hour_start
FROM axis WHERE timezone = 'Europe/Bucharest'""",
        "axis",
    )
)
def settlement_axis_rows(spark, sf_dir):
    """Every settlement slot of every order day in one zone."""
    days = fr.order_days(spark, sf_dir).withColumn("timezone", F.lit("Europe/Bucharest"))
    return settlement_axis(days)


@query(
    sql(
        f"""SELECT timezone, {date_id('date')} AS date_id, count(*) AS slots, min(timestamp_utc) AS first_utc,
  max(timestamp_utc) AS last_utc, CAST(sum({clock('loc')}) AS BIGINT) AS clock_sum,
  count(*) FILTER (utc_offset > standard) AS dst_slots, count(*) FILTER (repeated) AS repeated_slots
FROM axis GROUP BY timezone, date""",
        "axis",
    )
)
def axis_per_zone(spark, sf_dir):
    """Digest of the axis of every order day in three zones."""
    return settlement_axis(fr.order_zone_days(spark, sf_dir)).groupBy("timezone", "date_id").agg(
        F.count("*").alias("slots"),
        F.min("timestamp_utc").alias("first_utc"),
        F.max("timestamp_utc").alias("last_utc"),
        F.sum("local_time_id").alias("clock_sum"),
        F.count(F.when(F.col("is_dst"), 1)).alias("dst_slots"),
        F.count(F.when(F.col("is_repeated_hour"), 1)).alias("repeated_slots"),
    )


@query(
    sql(
        f"""SELECT timezone, {date_id('date')} AS date_id,
  CAST(min(slot) FILTER (hour(loc) >= 8 AND hour(loc) < 20) AS INTEGER) AS first_peak,
  CAST(max(slot) FILTER (hour(loc) >= 8 AND hour(loc) < 20) AS INTEGER) AS last_peak
FROM axis GROUP BY timezone, date""",
        "axis",
    )
)
def axis_peak_range(spark, sf_dir):
    """First and last peak slot per day and zone."""
    return peak_slot_range(settlement_axis(fr.order_zone_days(spark, sf_dir)))


@query(
    sql(
        f"""SELECT timezone, date,
  CAST(date_diff('minute', {instant('date', 'timezone')}, {instant('date + 1', 'timezone')}) / 60 AS DOUBLE) AS hours,
  CAST(date_diff('minute', {instant('date', 'timezone')}, {instant('date + 1', 'timezone')}) // 15 AS INTEGER) AS slots,
  {instant('date', 'timezone')} AS begins_utc
FROM order_days CROSS JOIN zones""",
        "order_days", "zones",
    )
)
def day_length(spark, sf_dir):
    """Length of every order day and the instant it begins, per zone."""
    tz = F.col("timezone")
    return fr.order_zone_days(spark, sf_dir).select(
        "timezone", "date",
        ft.day_length_hours("date", tz).alias("hours"),
        ft.slots_in_day("date", tz).alias("slots"),
        ft.local_midnight_utc("date", tz).alias("begins_utc"),
    )


@query(
    sql(
        f"""SELECT event_id, moved, {date_id('loc')} AS date_id, CAST(hour(loc) * 4 AS INTEGER) AS time_id,
  date_trunc('hour', u) AS hour_start_utc, loc AS local_ts, strftime(loc, '%H:%M') AS time_label,
  CAST(date_diff('minute', date_trunc('minute', u), date_trunc('minute', loc)) AS INTEGER) AS utc_offset_minutes,
  date_diff('minute', date_trunc('minute', u), date_trunc('minute', loc)) > standard AS is_dst,
  {local("u - INTERVAL 1 HOUR", 'timezone')} = loc AS is_repeated_hour,
  CAST(date_diff('second', {instant("date_trunc('day', loc)", 'timezone')}, date_trunc('second', u)) // 900 + 1 AS INTEGER)
    AS interval_of_day
FROM (SELECT *, {local('u', 'timezone')} AS loc FROM (
  SELECT event_id, moved, ts + to_days(moved) AS u,
    CASE user_id % 3 WHEN 0 THEN 'Europe/Bucharest' WHEN 1 THEN 'Europe/Berlin' ELSE 'Europe/London' END AS timezone
  FROM events CROSS JOIN (VALUES (65), (285)) v(moved))) JOIN zones USING (timezone)""",
        "zones",
    )
)
def local_keys(spark, sf_dir):
    """Local keys of instants around both changeovers in three zones."""
    tz = zones(fr.MARKETS)
    moved = F.explode(F.array(F.lit(fr.SPRING), F.lit(fr.AUTUMN)))
    events = table(spark, sf_dir, "events").withColumn("moved", moved).select(
        "event_id", "moved",
        fr.shifted("ts", F.col("moved").cast("long") * 86400000000).alias("timestamp_utc"),
        fr.choose(F.col("user_id"), *[m.timezone for m in fr.MARKETS.values()]).alias("timezone"),
    )
    return ft.with_local_keys(events, tz).select(
        "event_id", "moved", "date_id", "time_id", "hour_start_utc", "local_ts",
        ft.clock_label("local_ts").alias("time_label"),
        ft.utc_offset_minutes("timestamp_utc", tz).alias("utc_offset_minutes"),
        ft.is_dst("timestamp_utc", tz).alias("is_dst"),
        ft.is_repeated("timestamp_utc", tz).alias("is_repeated_hour"),
        ft.interval_of_day("timestamp_utc", tz).alias("interval_of_day"),
    )


def _zoned_slots(spark, sf_dir):
    current = latest_per_key(fr.price_obs(spark, sf_dir), OPCOM_PRICES.keys)
    return silver.with_market(current, fr.MARKETS, "timezone")


@query(
    sql(
        f"""SELECT market_id, {date_id('delivery_date')} AS date_id, interval_15min AS interval_of_day, timestamp_utc,
  {clock(local('timestamp_utc', 'timezone'))} AS local_time_id
FROM price_slots WHERE on_axis""",
        "price_slots",
    )
)
def axis_join(spark, sf_dir):
    """Slot numbers resolved through a stored axis."""
    slots = _zoned_slots(spark, sf_dir).select(
        "market_id", "timezone", ft.date_id("delivery_date").alias("date_id"),
        F.col("interval_15min").alias("interval_of_day"),
    )
    shipped = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
    return join_axis(slots, settlement_axis(fr.in_every_zone(shipped.distinct()))).drop("timezone")


@query(
    sql(
        """SELECT market_id, delivery_date, interval_15min FROM price_slots WHERE NOT on_axis""",
        "price_slots",
    )
)
def axis_misses(spark, sf_dir):
    """Prices whose slot number does not exist on their day."""
    slots = _zoned_slots(spark, sf_dir)
    return quality.axis_misses(slots, "delivery_date", "interval_15min", "timezone").select(
        *OPCOM_PRICES.keys
    )


# ---- exchange rates --------------------------------------------------------------------


@query(sql("SELECT * FROM fx", "fx"))
def fx_reconcile(spark, sf_dir):
    """Daily rate per pair: primary, else secondary, else carried forward."""
    return fr.exchange_rates(spark, sf_dir)


# A range that begins in the middle of the history, after weeks without a rate.
_MID, _MID_END = date(1998, 3, 1), date(1999, 6, 30)
_SILENT = (date(1998, 1, 10), date(1998, 3, 20))


@query(
    sql(
        f"""SELECT * FROM (
  SELECT d.date, 'EUR' AS base_currency, q.quote_currency,
    CASE q.quote_currency WHEN 'EUR' THEN 1.0::DOUBLE ELSE last_value(s.rate IGNORE NULLS) OVER walk END AS rate,
    CASE WHEN q.quote_currency = 'EUR' THEN 'SYNTHETIC' WHEN s.rate IS NULL THEN 'FORWARD_FILLED' ELSE s.source END AS source
  FROM (SELECT CAST(unnest(generate_series(DATE '1990-01-01', DATE '{_MID_END}', INTERVAL 1 DAY)) AS DATE) AS date) d
  CROSS JOIN (VALUES ('RON'), ('GBP'), ('EUR')) q(quote_currency)
  LEFT JOIN (SELECT date, quote_currency, coalesce(b.rate, e.rate) AS rate, coalesce(b.source, e.source) AS source
    FROM bnr_latest b FULL JOIN ecb_latest e USING (date, quote_currency)
    WHERE date NOT BETWEEN DATE '{_SILENT[0]}' AND DATE '{_SILENT[1]}') s USING (date, quote_currency)
  WINDOW walk AS (PARTITION BY q.quote_currency ORDER BY d.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
) WHERE date >= DATE '{_MID}' AND rate IS NOT NULL""",
        "bnr_latest", "ecb_latest",
    )
)
def fx_from_mid_history(spark, sf_dir):
    """Rates of a range that no source published just before: the last one known enters, however old."""
    heard = ~F.col("date").between(*map(F.lit, _SILENT))
    bnr, ecb = (obs(spark, sf_dir).filter(heard) for obs in (fr.bnr_obs, fr.ecb_obs))
    return silver.exchange_rates(bnr, ecb, fr.MARKETS, _MID, _MID_END)


@query(
    """SELECT o_orderpriority, date, last_value(seen IGNORE NULLS) OVER (PARTITION BY o_orderpriority ORDER BY date
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen
FROM (SELECT o_orderpriority, o_orderdate AS date,
  min(o_totalprice) FILTER (o_orderstatus = 'P') AS seen FROM orders GROUP BY 1, 2)"""
)
def forward_fill_chunked(spark, sf_dir):
    """Gaps in a daily series filled month by month."""
    daily = table(spark, sf_dir, "orders").groupBy(
        "o_orderpriority", F.col("o_orderdate").cast("timestamp").alias("date")
    ).agg(F.min(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("seen"))
    return forward_fill(daily, ["o_orderpriority"], "date", ["seen"], chunk="month")


@query(
    """WITH r AS (SELECT CASE o_custkey % 3 WHEN 0 THEN 'RO' WHEN 1 THEN 'DE' ELSE 'GB' END AS market_id,
  o_orderdate AS at, max(struct_pack(o_totalprice, o_orderkey)) AS best
  FROM orders GROUP BY 1, 2)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.market_id, l.at,
  r.best.o_totalprice AS o_totalprice, r.best.o_orderkey AS o_orderkey
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate AS at,
  CASE l_returnflag WHEN 'A' THEN 'RO' WHEN 'N' THEN 'DE' ELSE 'GB' END AS market_id FROM lineitem) l
ASOF LEFT JOIN r ON l.market_id = r.market_id AND l.at >= r.at"""
)
def asof_rate(spark, sf_dir):
    """Last order at or before each shipment; three keys hold all rows."""
    shipped = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fr.lineitem_market().alias("market_id"),
        F.col("l_shipdate").cast("timestamp").alias("at"),
    )
    orders = table(spark, sf_dir, "orders").select(
        fr.choose(F.col("o_custkey"), "RO", "DE", "GB").alias("market_id"),
        F.col("o_orderdate").cast("timestamp").alias("at"), "o_totalprice", "o_orderkey",
    )
    return asof_join(shipped, orders, ["market_id"], "at", ["o_totalprice", "o_orderkey"], "day", 4)


@query(
    """SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL
  ELSE o_totalprice / (o_custkey % 5) END AS converted, o_totalprice / (o_custkey % 7 + 1) AS per_unit FROM orders"""
)
def fx_convert(spark, sf_dir):
    """Conversion with missing and zero rates, and rates quoted for many units."""
    key = F.col("o_custkey")
    rate = F.when(key % 5 == 1, None).otherwise((key % 5).cast("double"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        money.convert("o_totalprice", rate).alias("converted"),
        money.per_unit_rate("o_totalprice", key % 7 + 1).alias("per_unit"),
    )


@query(
    sql(
        """SELECT b.date, b.base_currency, b.quote_currency, b.rate AS primary_rate, e.rate AS secondary_rate,
  abs(e.rate - b.rate) / abs(b.rate) AS deviation, abs(e.rate - b.rate) / abs(b.rate) > 0.01 AS exceeds
FROM bnr_latest b JOIN ecb_latest e USING (date, base_currency, quote_currency)""",
        "bnr_latest", "ecb_latest",
    )
)
def rate_cross_check(spark, sf_dir):
    """Days on which both sources publish, and how far apart they are."""
    seen = silver.rate_observations(fr.bnr_obs(spark, sf_dir), fr.ecb_obs(spark, sf_dir))
    return reports.rate_cross_check(seen, "BNR", "ECB")


# ---- prices and signals ------------------------------------------------------------------


@query(sql("SELECT * FROM fact_price", "fact_price"))
def fact_price(spark, sf_dir):
    """Prices on the instant axis, converted."""
    return fr.fact_price(spark, sf_dir)


@query(sql("SELECT * FROM price_hourly", "price_hourly"))
def price_hourly(spark, sf_dir):
    """Hourly means with labels and peak flag."""
    return gold.price_hourly(fr.fact_price(spark, sf_dir), fr.MARKETS)


@query(
    sql(
        """SELECT market_id, currency, hour_start_utc, date_id, time_id, time_label, price_local_mwh, fx_rate,
  price_eur_mwh, is_peak, is_repeated_hour
FROM price_hourly JOIN mkt USING (market_id) WHERE market_id = 'RO' AND date_id BETWEEN 19950101 AND 20011231""",
        "price_hourly",
    )
)
def ask_prices(spark, sf_dir):
    """The price question for one market and a date range."""
    hourly = gold.price_hourly(fr.fact_price(spark, sf_dir), fr.MARKETS)
    return ask.prices(hourly, "RO", fr.FX_START, fr.FX_END, fr.MARKETS)


def _signals(spark, sf_dir):
    return gold.bess_signals(fr.fact_price(spark, sf_dir), fr.MARKETS, 2, 2)


@query(sql("SELECT * FROM signals", "signals"))
def bess_signals(spark, sf_dir):
    """Daily ranks, extremes, spread and charge/discharge signal."""
    return _signals(spark, sf_dir)


@query(
    sql(
        """SELECT * FROM signals WHERE market_id = 'GB' AND date_id = 19991031""",
        "signals",
    )
)
def ask_signals(spark, sf_dir):
    """The signal question for one market and an autumn changeover day."""
    return ask.signals(_signals(spark, sf_dir), "GB", date(1999, 10, 31))


@query(sql("SELECT * FROM windows", "windows"))
def arbitrage_windows(spark, sf_dir):
    """Contiguous charge and discharge windows of every day."""
    return ask.arbitrage_windows(_signals(spark, sf_dir))


@query(
    sql(
        """SELECT s.market_id, s.date_id, max(s.arbitrage_spread_eur_mwh) AS arbitrage_spread_eur_mwh,
  any_value(coalesce(w.charge, '')) AS charge, any_value(coalesce(w.discharge, '')) AS discharge
FROM signals s LEFT JOIN (SELECT market_id, date_id,
    string_agg(strftime(start_utc, '%Y-%m-%dT%H:%M:%S') || '/' || n_slots, ',' ORDER BY start_utc) FILTER (type = 'charge') AS charge,
    string_agg(strftime(start_utc, '%Y-%m-%dT%H:%M:%S') || '/' || n_slots, ',' ORDER BY start_utc) FILTER (type = 'discharge') AS discharge
    FROM windows GROUP BY 1, 2) w
  USING (market_id, date_id) GROUP BY 1, 2""",
        "windows",
    )
)
def day_windows(spark, sf_dir):
    """Both window lists per day, every window written as its start and number of slots."""
    listed = lambda c: F.array_join(
        F.transform(c, lambda w: F.concat_ws("/", ft.iso_utc(w["start_utc"]), w["n_slots"].cast("string"))), ","
    )
    return ask.day_windows(_signals(spark, sf_dir)).select(
        "market_id", "date_id", "arbitrage_spread_eur_mwh",
        listed("charge_windows").alias("charge"), listed("discharge_windows").alias("discharge"),
    )


@query(
    sql(
        """SELECT *, ingested_at AS valid_from, lead(ingested_at) OVER (
  PARTITION BY market_id, delivery_date, interval_15min ORDER BY ingested_at) AS valid_to
FROM (SELECT * FROM price_obs QUALIFY row_number() OVER (PARTITION BY market_id, delivery_date, interval_15min, ingested_at
  ORDER BY price_lei_mwh DESC NULLS LAST, volume_mw DESC, volume_buy_mw DESC, volume_sell_mw DESC) = 1)""",
        "price_obs",
    )
)
def price_validity(spark, sf_dir):
    """From when to when every stored price was the current one."""
    return versions.validity(fr.price_obs(spark, sf_dir), OPCOM_PRICES.keys, tiebreak=OPCOM_PRICES.values)


_KNOWN_RATES = """quoted AS (SELECT CAST(o_orderdate AS DATE) AS delivery_date, CASE o_orderstatus WHEN 'F' THEN 'RO' ELSE 'GB' END AS market_id,
  CAST(pow(2.0, o_custkey % 3 + 1) AS DOUBLE) AS rate, make_timestamp(epoch_us(o_orderdate) + (o_custkey % 72) * 3600000000 + o_orderkey) AS known_at
  FROM orders WHERE o_orderstatus <> 'P')"""


@query(
    sql(
        f""", {_KNOWN_RATES},
asked AS (SELECT *, date_trunc('day', ingested_at) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS known_at FROM price_obs)
SELECT a.market_id, a.delivery_date, a.interval_15min, a.price_lei_mwh, a.ingested_at, a.known_at, q.rate,
  a.price_lei_mwh / q.rate AS price_eur_mwh
FROM asked a ASOF LEFT JOIN quoted q ON q.market_id = a.market_id AND q.delivery_date = a.delivery_date AND q.known_at <= a.known_at""",
        "price_obs",
    )
)
def prices_as_known(spark, sf_dir):
    """Every stored price with the rate of its day that was known when the day of its ingest ended."""
    midnight = F.date_trunc("day", "ingested_at")
    end = F.timestamp_micros(F.unix_micros(midnight) + 86_400_000_000 - 1)
    asked = fr.price_obs(spark, sf_dir).select(
        "market_id", "delivery_date", "interval_15min", "price_lei_mwh", "ingested_at", end.alias("known_at")
    )
    quoted = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderdate").cast("date").alias("delivery_date"),
        F.when(F.col("o_orderstatus") == "F", "RO").otherwise("GB").alias("market_id"),
        F.pow(F.lit(2.0), F.col("o_custkey") % 3 + 1).alias("rate"),
        fr.shifted("o_orderdate", (F.col("o_custkey") % 72) * 3_600_000_000 + F.col("o_orderkey")).alias("published"),
    )
    known = versions.known_when(asked, quoted, ["market_id", "delivery_date"], "known_at", ["rate"], "published")
    return known.withColumn("price_eur_mwh", money.convert("price_lei_mwh", "rate"))


def _in_two_runs(df, keys):
    """All but the last of several revisions of a key, and then the last ones, ingested thirty years later."""
    key = Window.partitionBy(*keys)
    last = (F.max("ingested_at").over(key) == F.col("ingested_at")) & (F.min("ingested_at").over(key) < F.col("ingested_at"))
    marked = df.withColumn("_last", last)
    late = F.timestamp_micros(F.unix_micros(F.col("ingested_at").cast("timestamp")) + 10_950 * 86_400 * 1_000_000)
    yield marked.filter("NOT _last").drop("_last")
    yield marked.filter("_last").drop("_last").withColumn("ingested_at", late)


@query(sql("SELECT * FROM windows", "windows"))
def refresh_touched_days(spark, sf_dir):
    """Windows after a first run and one that rebuilds only the days that late prices and rates touch."""
    base = f"{shared_folder(spark).rstrip('/')}/refresh-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(base)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    european = fr.ecb_obs(spark, sf_dir).withColumn("source_file_date", F.col("date"))
    sources = [
        (BNR_RATES, "date", _in_two_runs(fr.bnr_obs(spark, sf_dir).withColumn("source_url", F.lit("")), BNR_RATES.keys)),
        (ECB_RATES, "date", _in_two_runs(european, ECB_RATES.keys)),
        (OPCOM_PRICES, "delivery_date", _in_two_runs(fr.price_obs(spark, sf_dir).withColumn("source_url", F.lit("")), OPCOM_PRICES.keys)),
    ]
    for _ in range(2):
        for bronze_table, by, batches in sources:
            bronze.append(stored(conform(next(batches), bronze_table), "batch"), bronze_table, base, by, "latest")
        refresh(spark, base, fr.FX_START, fr.FX_END, fr.MARKETS, 2, 2)
    return store.read_table(spark, ARBITRAGE_WINDOWS.path(base), schema=ARBITRAGE_WINDOWS.schema)


@query(
    sql(
        """SELECT market_id, delivery_date, interval_15min, price_lei_mwh,
  coalesce(price_lei_mwh > avg(price_lei_mwh) OVER d + 1.5 * stddev_samp(price_lei_mwh) OVER d, false) AS is_price_outlier,
  CASE WHEN volume_sell_mw <> 0 THEN volume_buy_mw / volume_sell_mw END AS buy_sell_ratio
FROM price_latest WINDOW d AS (PARTITION BY market_id, delivery_date)""",
        "price_latest",
    )
)
def price_outliers(spark, sf_dir):
    """Prices far above their day's mean, and the buy/sell ratio."""
    current = latest_per_key(fr.price_obs(spark, sf_dir), OPCOM_PRICES.keys)
    return reports.price_outliers(current, sigmas=1.5).select(
        *OPCOM_PRICES.keys, "price_lei_mwh", "is_price_outlier", "buy_sell_ratio"
    )


# ---- generation, load, weather -------------------------------------------------------------


@query(sql("SELECT * FROM fact_generation", "fact_generation"))
def fact_generation(spark, sf_dir):
    """Hourly mean per type across the autumn changeover."""
    return fr.fact_generation(spark, sf_dir)


@query(sql("SELECT * FROM fact_load", "fact_load"))
def fact_load(spark, sf_dir):
    """Hourly mean load."""
    return fr.fact_load(spark, sf_dir)


# Local days that begin and end inside the readings.
_CUT = (date(2024, 10, 20), date(2024, 11, 4))
_CUT_IDS = f"date_id BETWEEN {_CUT[0]:%Y%m%d} AND {_CUT[1]:%Y%m%d}"


@query(sql(f"SELECT * FROM fact_generation WHERE {_CUT_IDS}", "fact_generation"))
def fact_generation_days(spark, sf_dir):
    """Hourly means of some local days only."""
    return silver.fact_generation(fr.gen_obs(spark, sf_dir), fr.production_types(spark), fr.MARKETS, *_CUT)


@query(sql(f"SELECT * FROM fact_weather WHERE {_CUT_IDS}", "fact_weather"))
def fact_weather_days(spark, sf_dir):
    """Weather of some local days only."""
    places = dims.dim_location(fr.markets(spark))
    return silver.fact_weather(fr.weather_obs(spark, sf_dir), places, fr.MARKETS, *_CUT)


@query(sql("SELECT * FROM fact_price WHERE date_id BETWEEN 19970115 AND 19990630", "fact_price"))
def fact_price_days(spark, sf_dir):
    """Prices of some local days only."""
    return silver.fact_price(
        fr.price_obs(spark, sf_dir), fr.exchange_rates(spark, sf_dir), fr.MARKETS, date(1997, 1, 15), date(1999, 6, 30)
    )


# Zones whose local hours begin at half past or a quarter past, one of them with summer time.
_ODD_ZONES = {
    "IN": Market("10YIN-TEST-----X", "Asia/Kolkata", "INR", "India", fx_source="ECB"),
    "NP": Market("10YNP-TEST-----X", "Asia/Kathmandu", "NPR", "Nepal", fx_source="ECB"),
    "AU": Market("10YAU-TEST-----X", "Australia/Adelaide", "AUD", "South Australia", fx_source="ECB"),
}


@query(
    sql(
        f"""SELECT * FROM (SELECT {date_id('max(h)')} AS date_id, CAST(hour(max(h)) * 4 AS INTEGER) AS time_id,
  hour_start_utc, market_id, avg(actual_load_mw) AS actual_load_mw FROM (
    SELECT market_id, actual_load_mw, date_trunc('hour', loc) AS h, timestamp_utc - (loc - date_trunc('hour', loc)) AS hour_start_utc
    FROM (SELECT o.market_id, actual_load_mw, timestamp_utc, {local('timestamp_utc', 'o.zone')} AS loc FROM load_latest
      JOIN (VALUES ('RO', 'IN', 'Asia/Kolkata'), ('DE', 'NP', 'Asia/Kathmandu'), ('GB', 'AU', 'Australia/Adelaide'))
        o(old, market_id, zone) ON o.old = load_latest.market_id))
  GROUP BY hour_start_utc, market_id) WHERE {_CUT_IDS}""",
        "load_latest",
    )
)
def fact_load_half_hour_zone(spark, sf_dir):
    """Hourly mean load where local hours begin at half past or a quarter past."""
    renamed = F.create_map(*(F.lit(x) for pair in zip(("RO", "DE", "GB"), _ODD_ZONES) for x in pair))
    load = fr.load_obs(spark, sf_dir).withColumn("market_id", renamed[F.col("market_id")])
    return silver.fact_load(load, _ODD_ZONES, *_CUT)


@query(
    sql(
        """SELECT 'fact_price' AS "table", 'slot not on the axis' AS reason,
  market_id || '/' || CAST(delivery_date AS VARCHAR) AS key, count(*) AS dropped_rows
FROM price_slots WHERE NOT on_axis GROUP BY 3
UNION ALL SELECT 'fact_generation', 'unknown production type', production_type, count(*)
FROM gen_latest WHERE production_type NOT IN (SELECT production_type FROM types WHERE production_type_id <> 22) GROUP BY 3
UNION ALL SELECT 'fact_weather', 'unknown location', market_id || '/' || location_name, count(*)
FROM weather_latest WHERE location_name = 'Atlantis' GROUP BY 3""",
        "price_slots", "gen_latest", "types", "weather_latest",
    )
)
def dropped_rows(spark, sf_dir):
    """What the three fact builders leave out, by reason."""
    listed = production_types_frame(spark)
    places = dims.dim_location(fr.markets(spark))
    return (
        silver.dropped_prices(fr.price_obs(spark, sf_dir), fr.MARKETS, fr.FX_START, fr.FX_END)
        .unionByName(silver.dropped_generation(fr.gen_obs(spark, sf_dir), listed, fr.MARKETS, fr.GEN_START, fr.GEN_END))
        .unionByName(silver.dropped_weather(fr.weather_obs(spark, sf_dir), places, fr.MARKETS, fr.GEN_START, fr.GEN_END))
    )


@query(
    """SELECT event_type, date_trunc('hour', ts + INTERVAL 65 DAY) AS hour_start_utc,
  avg(floor(value * 4) / 4) AS value, max(user_id) AS last_user FROM events GROUP BY 1, 2"""
)
def hourly_mean(spark, sf_dir):
    """Hourly mean with a carried label, across the spring changeover."""
    moved = table(spark, sf_dir, "events").select(
        "event_type", fr.shifted("ts", fr.days(fr.SPRING)).alias("at"),
        fr.quarters("value").alias("value"), F.col("user_id").alias("last_user"),
    )
    hour = {"hour_start_utc": ft.hour_start_utc("at")}
    return mean_by(moved, ["event_type"], hour, ["value"], ["last_user"])


_READ = ("solar_mw", "wind_onshore_mw", "nuclear_mw", "fossil_gas_mw")
_MIX = (*_READ, "other_discovered_mw")
# Types without readings: their columns hold 0.
_SILENT_TYPES = tuple(c for c in mix_columns().values() if c not in _READ)


@query(sql(f"SELECT *, {', '.join(f'0.0::DOUBLE AS {c}' for c in _SILENT_TYPES)} FROM mix", "mix"))
def generation_hourly(spark, sf_dir):
    """Wide mix with roll-ups, all columns of it."""
    return fr.generation_hourly(spark, sf_dir).select(
        "market_id", "hour_start_utc", "date_id", "time_id", *_MIX, *_SILENT_TYPES, "total_mw", "renewable_mw",
        "thermal_mw", "nuclear_mw_total", "renewable_share_pct",
    )


@query(
    sql(
        f"""SELECT market_id, hour_start_utc, date_id, time_id, total_mw, renewable_mw, thermal_mw, nuclear_mw_total,
  renewable_share_pct, {len(_SILENT_TYPES) + len(_MIX)} AS n_sources, {', '.join(_MIX)},
  {', '.join(f'0.0::DOUBLE AS {c}' for c in _SILENT_TYPES)} FROM mix""",
        "mix",
    )
)
def ask_generation(spark, sf_dir):
    """The generation question, every entry of the source map in a column."""
    return ask.generation(fr.generation_hourly(spark, sf_dir)).select(
        "market_id", "hour_start_utc", "date_id", "time_id", "total_mw", "renewable_mw", "thermal_mw",
        "nuclear_mw_total", "renewable_share_pct", F.size("sources").alias("n_sources"),
        *[F.col("sources")[c].alias(c) for c in (*_MIX, *_SILENT_TYPES)],
    )


@query(
    sql(
        """UNPIVOT (SELECT market_id, hour_start_utc, solar_mw, wind_onshore_mw, nuclear_mw, fossil_gas_mw,
  other_discovered_mw FROM mix) ON solar_mw, wind_onshore_mw, nuclear_mw, fossil_gas_mw, other_discovered_mw
INTO NAME source VALUE mw""",
        "mix",
    )
)
def unpivot_mix(spark, sf_dir):
    """Wide mix back to long."""
    wide = fr.generation_hourly(spark, sf_dir).select("market_id", "hour_start_utc", *_MIX)
    return melt(wide, ["market_id", "hour_start_utc"], _MIX, "source", "mw")


@query(sql("SELECT * FROM fact_weather", "fact_weather"))
def fact_weather(spark, sf_dir):
    """Hourly weather of configured places, realized and forecast apart."""
    return fr.fact_weather(spark, sf_dir)


def _places(spark):
    return dims.dim_location(fr.markets(spark))


@query(sql("SELECT * FROM national", "national"))
def national_weather(spark, sf_dir):
    """Weighted wind, solar and demand signals."""
    return reports.national_weather(fr.fact_weather(spark, sf_dir), _places(spark))


@query(
    sql(
        """SELECT f.*, p.location_name, n.market_id, n.wind_signal, n.solar_signal, n.demand_signal
FROM fact_weather f JOIN places p USING (location_id)
JOIN national n ON n.market_id = p.market_id AND n.hour_start_utc = f.hour_start_utc AND n.data_type = f.data_type""",
        "national",
    )
)
def weather_hourly(spark, sf_dir):
    """Weather per place next to the national signals."""
    return reports.weather_hourly(fr.fact_weather(spark, sf_dir), _places(spark))


@query(
    sql(
        """, h AS (SELECT market_id, timestamp_utc AS hour_start_utc, avg(temperature_2m) AS temp_avg_c,
  avg(wind_speed_10m) AS wind_speed_10m_avg, avg(wind_speed_100m) AS wind_speed_100m_avg,
  avg(shortwave_radiation) AS solar_radiation_avg, avg(cloud_cover) AS cloud_cover_avg FROM weather_latest GROUP BY 1, 2)
SELECT g.market_id, g.timestamp_utc, g.production_type, g.actual_mw, h.* EXCLUDE (market_id, hour_start_utc),
  date_trunc('hour', g.timestamp_utc) AS hour_start_utc
FROM gen_latest g LEFT JOIN h ON g.market_id = h.market_id AND date_trunc('hour', g.timestamp_utc) = h.hour_start_utc""",
        "gen_latest", "weather_latest",
    )
)
def slots_with_weather(spark, sf_dir):
    """Quarter-hour rows with the hour's mean weather; no row is repeated."""
    slots = latest_per_key(fr.gen_obs(spark, sf_dir), ENTSOE_GENERATION.keys).drop("ingested_at")
    weather = latest_per_key(fr.weather_obs(spark, sf_dir), WEATHER.keys)
    return reports.price_with_weather(slots, weather)


@query(
    sql(
        """, p AS (SELECT market_id, date_trunc('hour', timestamp_utc) AS hour_start_utc,
  avg(actual_mw) AS avg_price_eur_mwh FROM gen_latest GROUP BY 1, 2),
g AS (SELECT market_id, hour_start_utc, CASE WHEN sum(actual_mw) > 0 THEN
  sum(CASE WHEN is_renewable THEN actual_mw ELSE 0 END) / sum(actual_mw) * 100.0 / 100.0 END AS renewable_share
  FROM fact_generation JOIN types USING (production_type_id) GROUP BY 1, 2)
SELECT p.*, g.renewable_share, l.actual_load_mw FROM p JOIN g USING (market_id, hour_start_utc)
LEFT JOIN fact_load l USING (market_id, hour_start_utc)""",
        "fact_generation", "fact_load",
    )
)
def cross_grain(spark, sf_dir):
    """Hourly price (here: mean reading), renewable share and load side by side."""
    slots = latest_per_key(fr.gen_obs(spark, sf_dir), ENTSOE_GENERATION.keys)
    slots = slots.withColumn("local_time_id", ft.clock_position(ft.local_time("timestamp_utc", "Europe/Bucharest")))
    return reports.cross_grain(
        slots.withColumnRenamed("actual_mw", "price_eur_mwh"), fr.fact_generation(spark, sf_dir),
        fr.production_types(spark), fr.fact_load(spark, sf_dir),
    )


# ---- keys and dimensions ---------------------------------------------------------------------


@query(
    """SELECT event_id, event_type, CASE event_type WHEN 'view' THEN 18 WHEN 'click' THEN 21 WHEN 'purchase' THEN 15
  ELSE 4 END AS production_type_id FROM events WHERE event_type <> 'error'"""
)
def fk_resolve(spark, sf_dir):
    """Rows whose type is listed, with its id."""
    named, listed = _named_events(spark, sf_dir)
    return resolve.resolve(named, listed, ["production_type"]).select(
        "event_id", "event_type", "production_type_id"
    )


@query(
    """SELECT 'Tidal Kite' AS production_type, count(*) AS dropped_rows FROM events
WHERE event_type = 'error' HAVING count(*) > 0"""
)
def fk_rejects(spark, sf_dir):
    """Dropped rows per unlisted type."""
    named, listed = _named_events(spark, sf_dir)
    return resolve.unresolved_counts(named, listed, ["production_type"])


def _named_events(spark, sf_dir):
    named = table(spark, sf_dir, "events").withColumn("production_type", fr.event_type_name())
    listed = production_types_frame(spark).select(
        "production_type_id", F.col("production_type_name").alias("production_type")
    )
    return named, listed


@query(
    """WITH seen AS (SELECT DISTINCT p_type AS production_type_name FROM part),
found AS (SELECT * FROM seen WHERE production_type_name NOT IN ('ECONOMY', 'LARGE'))
SELECT CAST(CASE production_type_name WHEN 'SMALL' THEN 9
  ELSE 9 + row_number() OVER (PARTITION BY production_type_name = 'SMALL' ORDER BY production_type_name) END AS INTEGER)
  AS production_type_id, production_type_name, 'Other' AS energy_category,
  false AS is_renewable, false AS is_variable, false AS is_dispatchable FROM found
UNION ALL SELECT * FROM (VALUES (1, 'ECONOMY', 'Thermal', false, false, true),
  (2, 'LARGE', 'Renewable', true, false, false))"""
)
def stable_ids(spark, sf_dir):
    """Two listed types, one discovered earlier, the others numbered above all ids."""
    listed = production_types_frame(
        spark,
        (("ECONOMY", "Thermal", False, False, True), ("LARGE", "Renewable", True, False, False)),
    )
    # Stored earlier: the id that type SMALL was given once.
    assigned = table(spark, sf_dir, "part").filter("p_type = 'SMALL'").select(
        F.col("p_type").alias("production_type_name"), F.lit(9).alias("production_type_id")
    ).distinct()
    seen = table(spark, sf_dir, "part").select(F.col("p_type").alias("production_type"))
    return dims.dim_production_type(listed, seen, assigned)


_TYPE_ROWS = ", ".join(str((i, *entry)) for i, entry in enumerate(PRODUCTION_TYPES, 1))


@query(
    f"""SELECT * FROM (VALUES {_TYPE_ROWS}) v(production_type_id, production_type_name, energy_category,
  is_renewable, is_variable, is_dispatchable)
UNION ALL SELECT 22, 'Tidal Kite', 'Other', false, false, false
WHERE EXISTS (SELECT 1 FROM events WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup'))"""
)
def dim_production_type(spark, sf_dir):
    """Published types and the one discovered in the readings."""
    listed = production_types_frame(spark)
    return dims.dim_production_type(listed, fr.gen_obs(spark, sf_dir), listed.limit(0))


@query(
    """SELECT c_name, CAST(row_number() OVER (ORDER BY c_name) AS INTEGER) AS position FROM customer
WHERE c_custkey % 10 <> 0"""
)
def numbered_names(spark, sf_dir):
    """Names numbered in order without gathering them in one task."""
    known = F.when(F.col("c_custkey") % 10 != 0, F.col("c_name"))
    names = table(spark, sf_dir, "customer").select(known.alias("c_name"))
    return resolve.number_in_order(names, "c_name")


_HOLIDAY_CTE = """cal AS (
  SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d
  FROM (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders)),
e AS (SELECT y, make_date(y, (dd + ee + 114) // 31, (dd + ee + 114) % 31 + 1) + 13 AS easter FROM (
  SELECT y, dd, (2 * (y % 4) + 4 * (y % 7) - dd + 34) % 7 AS ee FROM (
    SELECT y, (19 * (y % 19) + 15) % 30 AS dd FROM (SELECT DISTINCT CAST(year(d) AS INTEGER) AS y FROM cal))))"""


@query(
    f"""WITH {_HOLIDAY_CTE}
SELECT {date_id('d')} AS date_id, d AS full_date, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
  CAST(day(d) AS INTEGER) AS day_of_month, CAST(isodow(d) AS INTEGER) AS day_of_week,
  CAST(weekofyear(d) AS INTEGER) AS week_of_year, CAST(quarter(d) AS INTEGER) AS quarter, isodow(d) <= 5 AS is_weekday,
  strftime(d, '%m%d') IN ('0101', '0102', '0124', '0501', '0601', '0815', '1130', '1201', '1225', '1226')
    OR (year(d) >= 2024 AND strftime(d, '%m%d') IN ('0106', '0107'))
    OR date_diff('day', easter, d) IN (-2, 0, 1, 49, 50) AS is_ro_holiday,
  CASE WHEN month(d) IN (12, 1, 2) THEN 'Winter' WHEN month(d) <= 5 THEN 'Spring'
    WHEN month(d) <= 8 THEN 'Summer' ELSE 'Autumn' END AS season
FROM cal JOIN e ON e.y = year(d)"""
)
def dim_date(spark, sf_dir):
    """Calendar dimension over the span of the orders."""
    day = F.col("o_orderdate").cast("date")
    span = table(spark, sf_dir, "orders").agg(F.min(day).alias("start"), F.max(day).alias("end"))
    return dims.dim_date(date_spine(span))


@query(
    ORACLES["dim_date"].replace(
        "SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders",
        "SELECT CAST(min(ts) AS DATE) - 370 AS lo, CAST(max(ts) AS DATE) + 700 AS hi FROM events",
    )
)
def dim_date_of_events(spark, sf_dir):
    """Calendar dimension of the years around the events, when two more holidays came into force."""
    day = F.col("ts").cast("date")
    span = table(spark, sf_dir, "events").agg(
        F.date_sub(F.min(day), 370).alias("start"), F.date_add(F.max(day), 700).alias("end")
    )
    return dims.dim_date(date_spine(span))


@query(f"WITH {_HOLIDAY_CTE} SELECT y AS year, easter FROM e")
def easter(spark, sf_dir):
    """Orthodox Easter of every year with orders."""
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return years.select("year", cal.orthodox_easter("year").alias("easter"))


@query(
    """SELECT c_custkey, CAST(CAST('0x' || substr(md5(c_mktsegment || '::' || c_name), 1, 8) AS BIGINT) % 900000 + 100000
  AS INTEGER) AS location_id FROM customer"""
)
def location_id(spark, sf_dir):
    """Hash ids that need no lookup."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey", text.location_id("c_mktsegment", "c_name").alias("location_id")
    )


def _nation_markets(spark, sf_dir):
    """Nations as a market registry, with their suppliers' nations as weather points."""
    region = F.col("n_regionkey")
    currency = fr.choose(region, "RON", "EUR", "GBP")
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    point = F.struct(
        F.col("r_name").alias("name"), F.col("r_regionkey").cast("double").alias("latitude"),
        F.col("n_nationkey").cast("double").alias("longitude"), F.lit(0.5).alias("wind_weight"),
        F.lit(0.25).alias("solar_weight"), F.lit(0.25).alias("demand_weight"),
    )
    return nations.join(regions, region == F.col("r_regionkey")).select(
        F.col("n_name").alias("market_id"), F.col("n_name").alias("market_name"),
        F.col("r_name").alias("bidding_zone"),
        fr.choose(region, *[m.timezone for m in fr.MARKETS.values()]).alias("timezone"),
        currency.alias("currency"), F.lit("EUR").alias("reporting_currency"),
        F.when(currency == "RON", "BNR").otherwise("ECB").alias("fx_source"),
        F.lit(Market.peak_start_hour).alias("peak_start_hour"),
        F.lit(Market.peak_end_hour).alias("peak_end_hour"), F.array(point).alias("locations"),
    )


_NATION_ZONE = "CASE n_regionkey % 3 WHEN 0 THEN 'Europe/Bucharest' WHEN 1 THEN 'Europe/Berlin' ELSE 'Europe/London' END"
_NATION_CURRENCY = "CASE n_regionkey % 3 WHEN 0 THEN 'RON' WHEN 1 THEN 'EUR' ELSE 'GBP' END"


@query(
    f"""SELECT n_name AS market_id, n_name AS market_name, r_name AS bidding_zone, {_NATION_ZONE} AS timezone,
  {_NATION_CURRENCY} AS currency, 'EUR' AS reporting_currency, 8 AS peak_start_hour, 20 AS peak_end_hour
FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def dim_market(spark, sf_dir):
    """Market dimension from a registry frame."""
    return dims.dim_market(_nation_markets(spark, sf_dir))


@query(
    """SELECT CAST(CAST('0x' || substr(md5(n_name || '::' || r_name), 1, 8) AS BIGINT) % 900000 + 100000 AS INTEGER)
  AS location_id, r_name AS location_name, n_name AS market_id, CAST(r_regionkey AS DOUBLE) AS latitude,
  CAST(n_nationkey AS DOUBLE) AS longitude, 0.5::DOUBLE AS wind_weight, 0.25::DOUBLE AS solar_weight,
  0.25::DOUBLE AS demand_weight FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def dim_location(spark, sf_dir):
    """Location dimension from a registry frame."""
    return dims.dim_location(_nation_markets(spark, sf_dir))


@query(
    f"""SELECT DISTINCT 'EUR' AS base_currency, c AS quote_currency,
  CASE c WHEN 'EUR' THEN 'SYNTHETIC' WHEN 'RON' THEN 'BNR' ELSE 'ECB' END AS primary_source,
  CASE c WHEN 'RON' THEN 'ECB' END AS secondary_source FROM (SELECT {_NATION_CURRENCY} AS c FROM nation)"""
)
def currency_pairs(spark, sf_dir):
    """Pairs a registry needs, and their leading sources."""
    return required_pairs(_nation_markets(spark, sf_dir))


@query(f"SELECT DISTINCT {_NATION_ZONE} AS timezone FROM nation")
def market_zones(spark, sf_dir):
    """Distinct zones of a registry."""
    return market_timezones(_nation_markets(spark, sf_dir))


# ---- scalar functions ----------------------------------------------------------------------------


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS value FROM lineitem"""
)
def locale_number(spark, sf_dir):
    """Amounts written with a decimal comma, with a point, or unreadable."""
    cents = F.format_number("l_extendedprice", 2)
    comma = F.translate(cents, ",.", ".,")
    plain = F.regexp_replace(cents, ",", "")
    written = F.when(F.col("l_partkey") % 11 == 0, "n/a").when(
        F.col("l_partkey") % 2 == 0, comma
    ).otherwise(F.concat(F.lit(" "), plain, F.lit("  ")))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate"),
        text.locale_number(written).alias("value"),
    )


@query(
    """SELECT p_partkey, trim(regexp_replace(lower(p_name || '|' || p_brand || ' /' || p_type || '/'), '[^a-z0-9]+', '_', 'g'), '_')
  || '_mw' AS column_name, CASE WHEN p_size % 2 = 0 THEN p_name || '|' || p_brand ELSE p_name END AS flat FROM part"""
)
def slugify(spark, sf_dir):
    """Column names from free text, and two-level type names."""
    phrase = F.concat("p_name", F.lit("|"), "p_brand", F.lit(" /"), "p_type", F.lit("/"))
    subtype = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.megawatt_column(phrase).alias("column_name"),
        text.flat_type("p_name", subtype).alias("flat"),
    )


@query(
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso,
  'https://www.opcom.ro/rapoarte-pzu-raportPIP-export-csv/' || strftime(ts, '%d/%m/%Y') || '/ro?resolution=15' AS export_url,
  'https://www.bnr.ro/files/xml/years/nbrfxrates' || year(ts) || '.xml' AS archive_url,
  CASE WHEN event_id % 3 <> 0 THEN value END AS finite FROM events"""
)
def formatting(spark, sf_dir):
    """ISO text, source addresses and NaN removal."""
    maybe_nan = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select(
        "event_id", ft.iso_utc("ts").alias("iso"), text.price_source_url("ts").alias("export_url"),
        text.fx_archive_url("ts").alias("archive_url"), text.finite_or_null(maybe_nan).alias("finite"),
    )


# ---- usage and quality -----------------------------------------------------------------------------

_SINCE = datetime(2024, 1, 15)


@query(
    sql(
        """SELECT coalesce(any_value(c.c_name), '<unauthenticated>') AS key_display,
  coalesce(any_value(c.c_mktsegment), '-') AS name, count(*) AS requests,
  CAST(sum(CASE WHEN status_code >= 400 THEN 1 ELSE 0 END) AS BIGINT) AS errors,
  round(avg(duration_ms), 1) AS avg_ms, max(occurred_at) AS last_seen
FROM usage_events LEFT JOIN customer c ON c.c_custkey = key_id GROUP BY key_id""",
        "usage_events",
    )
)
def usage_summary(spark, sf_dir):
    """Requests, errors, latency and last use per key."""
    return usage.usage_summary(fr.usage_events(spark, sf_dir), fr.api_keys(spark, sf_dir))


@query(
    sql(
        """SELECT key_id, count(*) AS n FROM usage_events WHERE occurred_at >= TIMESTAMP '2024-01-15' GROUP BY key_id""",
        "usage_events",
    )
)
def requests_since(spark, sf_dir):
    """Requests per key since an instant."""
    return usage.requests_since(fr.usage_events(spark, sf_dir), _SINCE)


def _busy_events(spark, sf_dir):
    """All requests spread over just two keys."""
    return table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 2).alias("key_id"), F.col("ts").cast("timestamp").alias("occurred_at")
    )


@query(
    """SELECT event_id, user_id % 2 AS key_id, ts AS occurred_at, count(*) OVER (PARTITION BY user_id % 2 ORDER BY ts
  RANGE BETWEEN INTERVAL '899.999999 seconds' PRECEDING AND CURRENT ROW) AS recent FROM events"""
)
def trailing_requests(spark, sf_dir):
    """Requests of the last quarter hour at each request; two keys hold all rows."""
    return usage.trailing_requests(_busy_events(spark, sf_dir), 900, 1800)


@query(
    """SELECT key_id, max(recent) AS peak, any_value(c_nationkey % 3 + 1) AS rate_limit_per_min FROM (
  SELECT user_id % 2 AS key_id, count(*) OVER (PARTITION BY user_id % 2 ORDER BY ts
    RANGE BETWEEN INTERVAL '59.999999 seconds' PRECEDING AND CURRENT ROW) AS recent FROM events)
JOIN customer ON c_custkey = key_id GROUP BY key_id HAVING max(recent) > any_value(c_nationkey % 3 + 1)"""
)
def over_limit(spark, sf_dir):
    """Keys whose busiest minute exceeds their limit."""
    return usage.over_limit(_busy_events(spark, sf_dir), fr.api_keys(spark, sf_dir))


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id % 8 AS key_id, ts, epoch_us(ts) AS us,
  row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS i FROM events),
l AS (SELECT c_custkey AS key_id, c_nationkey % 3 + 1 AS lim FROM customer WHERE c_custkey BETWEEN 1 AND 7),
w(key_id, i, hits, us, free, lim) AS (SELECT key_id, 0::BIGINT, []::BIGINT[], 0::BIGINT, 0::BIGINT, lim::BIGINT FROM l
  UNION ALL SELECT e.key_id, e.i, CASE WHEN len(list_filter(w.hits, lambda x: x > e.us - 3600000000)) < w.lim
    THEN list_append(list_filter(w.hits, lambda x: x > e.us - 3600000000), e.us)
    ELSE list_filter(w.hits, lambda x: x > e.us - 3600000000) END, e.us,
    w.lim - len(list_filter(w.hits, lambda x: x > e.us - 3600000000)), w.lim
  FROM w JOIN e ON e.key_id = w.key_id AND e.i = w.i + 1)
SELECT e.event_id, e.key_id, e.ts AS occurred_at, w.lim IS NULL OR w.free > 0 AS allowed, w.lim AS "limit",
  CASE WHEN w.lim IS NOT NULL THEN greatest(w.free - 1, 0) END AS remaining,
  CASE WHEN w.lim IS NULL OR w.free > 0 THEN 0 ELSE greatest(1, (w.hits[1] + 3600000000 - e.us) // 1000000 + 1) END AS retry_after
FROM e LEFT JOIN w USING (key_id, i)"""
)
def request_admission(spark, sf_dir):
    """What a limiter of so many requests an hour answers to each request; keys 1 to 7 have a limit."""
    events = table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 8).alias("key_id"), F.col("ts").cast("timestamp").alias("occurred_at")
    )
    limits = fr.api_keys(spark, sf_dir).where("id BETWEEN 1 AND 7").select(
        F.col("id").alias("key_id"), F.col("rate_limit_per_min").alias("limit")
    )
    return usage.admission(events, limits, ["event_id"], seconds=3600)


def _calendar_by_priority(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    orders = table(spark, sf_dir, "orders")
    first, last = orders.agg(F.min(day)).scalar(), orders.agg(F.max(day)).scalar()
    priorities = orders.select("o_orderpriority").distinct()
    return date_spine(priorities.select("o_orderpriority", first.alias("start"), last.alias("end")))


_EXPECTED = """days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM (
  SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders)),
expected AS (SELECT o_orderpriority, date FROM days CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders))"""


@query(
    f"""WITH {_EXPECTED}, tried AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS date,
  min(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) AS s FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, date, CASE s WHEN 1 THEN 'fetched' WHEN 2 THEN 'skipped' WHEN 3 THEN 'failed' ELSE 'missing' END
  AS status FROM expected LEFT JOIN tried USING (o_orderpriority, date)"""
)
def coverage(spark, sf_dir):
    """Outcome per expected day and source."""
    status = F.when(F.col("o_orderstatus") == "F", "fetched").when(
        F.col("o_orderstatus") == "O", "skipped"
    ).otherwise("failed")
    attempts = table(spark, sf_dir, "orders").select(
        "o_orderpriority", F.col("o_orderdate").cast("date").alias("date"), status.alias("status")
    )
    return quality.coverage(_calendar_by_priority(spark, sf_dir), attempts, ["o_orderpriority", "date"])


@query(
    f"""WITH {_EXPECTED} SELECT * FROM expected e WHERE NOT EXISTS (SELECT 1 FROM orders o
  WHERE o.o_orderpriority = e.o_orderpriority AND CAST(o.o_orderdate AS DATE) = e.date)"""
)
def missing_days(spark, sf_dir):
    """Expected days without data, per source."""
    present = table(spark, sf_dir, "orders").select(
        "o_orderpriority", F.col("o_orderdate").cast("date").alias("date")
    )
    return quality.missing_days(_calendar_by_priority(spark, sf_dir), present, ["o_orderpriority", "date"])


def _manifest(spark, sf_dir):
    """The days tried, recorded by three runs, by source and outcome."""
    path = f"{shared_folder(spark).rstrip('/')}/manifest-{uuid.uuid4().hex}/days"
    place = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    status = F.when(F.col("o_orderstatus") == "F", "fetched").when(F.col("o_orderstatus") == "O", "skipped").otherwise("failed")
    tried = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("date"), status.alias("status")
    )
    by = ["o_orderpriority", "status"]
    for run in range(3):
        manifest.record_days(spark, path, tried.filter(F.col("o_orderkey") % 3 == run), by)
    return store.read_table(spark, path)


@query(ORACLES["coverage"])
def coverage_of_manifest(spark, sf_dir):
    """The same from bitmaps of days that three runs have recorded."""
    return manifest.coverage_of_manifest(_calendar_by_priority(spark, sf_dir), _manifest(spark, sf_dir), ["o_orderpriority"])


@query(ORACLES["missing_days"])
def missing_in_manifest(spark, sf_dir):
    """Expected days that no run has recorded, from bitmaps."""
    held = manifest.merged_bitmaps(_manifest(spark, sf_dir), ["o_orderpriority"])
    return manifest.missing_in_manifest(_calendar_by_priority(spark, sf_dir), held, ["o_orderpriority"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    """Keys that occur more than once."""
    return quality.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    sql(
        """SELECT 'price_lei_mwh' AS "column", count(*) FILTER (price_lei_mwh IS NULL) AS nulls,
  count(*) FILTER (price_lei_mwh < -30000) AS below, count(*) FILTER (price_lei_mwh > 30000) AS above FROM price_obs
UNION ALL SELECT 'volume_mw', 0, 0, count(*) FILTER (volume_mw > 40) FROM price_obs""",
        "price_obs",
    )
)
def range_violations(spark, sf_dir):
    """NULLs and values outside their bounds."""
    bounds = {"price_lei_mwh": (-30000.0, 30000.0), "volume_mw": (None, 40.0)}
    return quality.range_violations(fr.price_obs(spark, sf_dir), bounds)


@query(
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS "rows", 0::BIGINT AS nulls, min({c})::DOUBLE AS low,
  quantile_disc({c}, 0.25)::DOUBLE AS q1, quantile_disc({c}, 0.5)::DOUBLE AS median,
  quantile_disc({c}, 0.75)::DOUBLE AS q3, max({c})::DOUBLE AS high FROM lineitem"""
        for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice")
    )
)
def profile(spark, sf_dir):
    """Row counts, NULLs, extremes and quartiles."""
    columns = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice"]
    return quality.profile(table(spark, sf_dir, "lineitem"), columns)


@query(
    sql(
        """SELECT market_id, "column", count(*) AS "rows", count(*) - count(value) AS nulls, min(value)::DOUBLE AS low, max(value)::DOUBLE AS high,
  true AS q1_within, true AS median_within, true AS q3_within
FROM (SELECT market_id, 'price_lei_mwh' AS "column", price_lei_mwh AS value FROM price_obs
  UNION ALL SELECT market_id, 'volume_mw', volume_mw FROM price_obs) GROUP BY 1, 2""",
        "price_obs",
    )
)
def profile_of_sketches(spark, sf_dir):
    """Counts, extremes, and whether quartiles merged from sketches of single months have ranks within their bound."""
    rows, columns = fr.price_obs(spark, sf_dir), ["price_lei_mwh", "volume_mw"]
    monthly = sketches.sketched(
        rows.withColumn("month", F.trunc("delivery_date", "month")), ["market_id", "month"], columns
    )
    merged = stored(sketches.merged_sketches(monthly, ["market_id"]), "sketches")
    return sketches.within_error(rows, sketches.approximate_profile(merged), ["market_id"], columns)


_OFFSET = "CAST((epoch(timezone(zone, timezone('UTC', ts))) - epoch(ts)) / 60 AS INTEGER)"


@query(
    f"""SELECT event_id, timezone, timestamp_utc, offset_minutes, CASE timezone WHEN 'Europe/Berlin' THEN offset_minutes <> 60
  WHEN 'Europe/Dublin' THEN offset_minutes <> 60 WHEN 'America/New_York' THEN offset_minutes <> -300
  WHEN 'Europe/Moscow' THEN offset_minutes = 240 AND timestamp_utc < TIMESTAMP '2011-03-01' ELSE false END AS is_dst
FROM (SELECT event_id, zone AS timezone, ts AS timestamp_utc, {_OFFSET} AS offset_minutes FROM (
  SELECT event_id, ts - to_days(CAST(event_id % 5000 AS INTEGER)) AS ts, unnest(['Europe/Berlin', 'Europe/Dublin', 'Europe/Moscow',
    'America/New_York', 'Asia/Kolkata']) AS zone FROM events))"""
)
def zone_offsets(spark, sf_dir):
    """Offset and summer time of instants since 2010, also where the standard offset changes or summer time is behind it."""
    named = ("Europe/Berlin", "Europe/Dublin", "Europe/Moscow", "America/New_York", "Asia/Kolkata")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - (F.col("event_id") % 5000) * 86_400_000_000
    instants = table(spark, sf_dir, "events").select("event_id", F.timestamp_micros(micros).alias("timestamp_utc"))
    wanted = instants.select("*", F.explode(F.array(*[F.lit(z) for z in named])).alias("timezone"))
    spans = zone_spans(spark, named, date(2010, 1, 1), date(2024, 12, 31))
    return with_offsets(wanted, spans).select("event_id", "timezone", "timestamp_utc", "offset_minutes", "is_dst")


@query(
    sql(
        f"""SELECT market_id, delivery_date, timezone, count(*) AS stored,
  CAST(date_diff('minute', {instant('delivery_date', 'timezone')}, {instant('delivery_date + 1', 'timezone')}) // 15
    AS INTEGER) AS expected,
  count(*) = date_diff('minute', {instant('delivery_date', 'timezone')}, {instant('delivery_date + 1', 'timezone')}) // 15
    AS complete
FROM price_slots WHERE on_axis GROUP BY market_id, delivery_date, timezone""",
        "price_slots",
    )
)
def slots_per_day(spark, sf_dir):
    """Stored slots next to the slots a day has."""
    slots = _zoned_slots(spark, sf_dir)
    real = slots.filter(ft.slot_exists("delivery_date", "interval_15min", F.col("timezone")))
    return quality.slots_per_day(real, "delivery_date", "timezone", ["market_id"])
