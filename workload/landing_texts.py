"""Landing files written as text from the given tables, read back by the source parsers.

Every file is one day of one source, so it is bounded by the slots of a day.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions import text
from wattframe.functions import time as ft
from wattframe.operators import changes
from wattframe.operators.latest import latest_per_key
from wattframe.operators.staging import shared_folder
from wattframe.schemas import BNR_RATES, ECB_RATES, ENTSOE_GENERATION, ENTSOE_LOAD, OPCOM_PRICES, WEATHER, Table
from wattframe.sources import landing, prices, rates, series

from . import frames as fr
from .catalog import ORACLES, query
from .frames import sql, table


def lines(row: Column, order: str) -> Column:
    """The group's rows as text lines in order."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order), row.alias("_line"))))
    return F.array_join(F.transform(ordered, lambda r: r["_line"]), "\n")


# ---- day-ahead price exports -----------------------------------------------------------


def price_files(spark, sf_dir) -> DataFrame:
    """One CSV per market and day, half of the rows with decimal commas."""
    current = latest_per_key(fr.price_obs(spark, sf_dir), OPCOM_PRICES.keys)
    quote = lambda c: F.concat(F.lit('"'), F.coalesce(c.cast("string"), F.lit("")), F.lit('"'))
    price = F.when(
        F.col("interval_15min") % 2 == 1, F.replace(F.col("price_lei_mwh").cast("string"), F.lit("."), F.lit(","))
    ).otherwise(F.col("price_lei_mwh").cast("string"))
    cells = [F.col("market_id"), F.col("interval_15min"), price, F.col("volume_mw"),
             F.col("volume_buy_mw"), F.col("volume_sell_mw"), F.lit("PT15M")]
    row = F.concat_ws(",", *[quote(c) for c in cells])
    head = (
        '"PIP si volum tranzactionat"\n\n"","Pret mediu [lei/MWh]","Volum [MWh]","Rezolutie"\n'
        '"ROPEX_DAM_Base (1-24)","1.5","2.5","PT15M"\n\n'
        f'"{prices.HEADER_CELL}","Interval","Pret","Volum","Cumparare","Vanzare","Rezolutie"\n'
    )
    return current.groupBy("market_id", "delivery_date").agg(lines(row, "interval_15min").alias("_body")).select(
        F.format_string("file:/land/landing/opcom_pzu/%s/%s.csv", "market_id", F.col("delivery_date").cast("string")).alias("path"),
        F.concat(F.lit(head), "_body").alias("value"),
    )


_PRICE_DAYS = """, day AS (SELECT market_id, delivery_date, max(interval_15min) AS highest,
  count(*) FILTER (price_lei_mwh IS NULL) AS malformed FROM price_latest GROUP BY 1, 2),
valid AS (SELECT market_id, delivery_date, max(interval_15min) AS highest FROM price_latest
  WHERE price_lei_mwh IS NOT NULL GROUP BY 1, 2)"""


@query(
    sql(
        _PRICE_DAYS
        + """
SELECT market_id, delivery_date, interval_15min, price_lei_mwh, volume_mw, volume_buy_mw, volume_sell_mw,
  'https://www.opcom.ro/rapoarte-pzu-raportPIP-export-csv/' || strftime(delivery_date, '%d/%m/%Y') || '/ro?resolution=15'
  AS source_url
FROM price_latest JOIN valid USING (market_id, delivery_date)
WHERE highest BETWEEN 92 AND 100 AND price_lei_mwh IS NOT NULL""",
        "price_latest",
    )
)
def csv_prices(spark, sf_dir):
    """Price rows parsed from the exports of accepted days."""
    return prices.accepted_prices(prices.parse_price_files(price_files(spark, sf_dir)))


@query(
    sql(
        _PRICE_DAYS
        + """
SELECT market_id, delivery_date, highest, CASE WHEN highest BETWEEN 23 AND 25 THEN 'hourly' ELSE 'changed' END AS reason
FROM valid WHERE highest NOT BETWEEN 92 AND 100""",
        "price_latest",
    )
)
def csv_rejected_days(spark, sf_dir):
    """Days refused for their resolution."""
    return prices.rejected_days(prices.parse_price_files(price_files(spark, sf_dir)))


@query(
    sql(
        _PRICE_DAYS + "\nSELECT market_id, delivery_date, CAST(malformed AS INTEGER) AS malformed_rows FROM day WHERE malformed > 0",
        "price_latest",
    )
)
def csv_malformed_rows(spark, sf_dir):
    """Days with rows dropped for an unreadable number."""
    return prices.malformed_counts(prices.parse_price_files(price_files(spark, sf_dir)))


# ---- generation, load, weather (JSON) --------------------------------------------------


def record_files(rows: DataFrame, kind: str, *columns: str) -> DataFrame:
    """One JSON per market and UTC day."""
    record = F.struct(ft.iso_utc("timestamp_utc").alias("timestamp_utc"), *columns)
    return rows.groupBy("market_id", F.to_date("timestamp_utc").alias("date")).agg(
        F.collect_list(record).alias("records")
    ).select(
        F.format_string(f"file:/land/landing/entsoe/%s/{kind}/%s.json", "market_id", F.col("date").cast("string")).alias("path"),
        F.to_json(F.struct("market_id", "date", "records")).alias("value"),
    )


@query(sql("SELECT market_id, timestamp_utc, production_type, actual_mw FROM gen_latest", "gen_latest"))
def json_generation(spark, sf_dir):
    """Generation records parsed from daily files."""
    rows = latest_per_key(fr.gen_obs(spark, sf_dir), ENTSOE_GENERATION.keys)
    return series.parse_generation(record_files(rows, "generation", "production_type", "actual_mw"))


@query(sql("SELECT * FROM load_latest", "load_latest"))
def json_load(spark, sf_dir):
    """Load records parsed from daily files."""
    rows = latest_per_key(fr.load_obs(spark, sf_dir), ENTSOE_LOAD.keys)
    return series.parse_load(record_files(rows, "load", "actual_load_mw"))


@query(
    sql(
        """SELECT market_id, location_name, 44.5::DOUBLE AS lat, 26.0::DOUBLE AS lon, timestamp_utc, data_type,
  temperature_2m, wind_speed_10m, wind_speed_100m, shortwave_radiation, cloud_cover,
  CASE data_type WHEN 'FORECAST' THEN 'http://forecast' END AS source_url FROM weather_latest""",
        "weather_latest",
    )
)
def json_weather(spark, sf_dir):
    """Hourly rows parsed from parallel arrays; realized files carry no kind."""
    rows = latest_per_key(fr.weather_obs(spark, sf_dir), WEATHER.keys)
    hour = F.struct(F.date_format("timestamp_utc", "yyyy-MM-dd'T'HH:mm").alias("time"), *series.WEATHER_VARIABLES)
    hours = rows.groupBy("market_id", "location_name", "data_type", F.to_date("timestamp_utc").alias("date")).agg(
        F.sort_array(F.collect_list(hour)).alias("h")
    )
    arrays = F.struct(*[F.col(f"h.{v}").alias(v) for v in ("time", *series.WEATHER_VARIABLES)])
    forecast = F.col("data_type") == "FORECAST"
    body = F.struct(
        F.col("location_name").alias("location"), F.lit(44.5).alias("lat"), F.lit(26).alias("lon"),
        F.when(forecast, F.col("data_type")).alias("data_type"),
        F.when(forecast, "http://forecast").alias("source_url"), arrays.alias("hourly"),
    )
    files = hours.select(
        F.format_string("file:/land/landing/weather/%s/%s/%s.json", "market_id", "location_name", F.col("date").cast("string")).alias("path"),
        F.to_json(body).alias("value"),
    )
    return series.parse_weather(files)


@query(
    sql(
        """SELECT timestamp_utc, production_type, actual_mw FROM (
  SELECT hour_start_utc AS timestamp_utc, 'Solar' AS production_type, CASE WHEN solar_mw <> 0 THEN solar_mw END AS actual_mw
  FROM mix WHERE market_id = 'RO'
  UNION ALL SELECT hour_start_utc, 'Hydro Pumped Storage|Actual Consumption', CASE WHEN nuclear_mw <> 0 THEN nuclear_mw END
  FROM mix WHERE market_id = 'RO')""",
        "mix",
    )
)
def wide_frame_to_records(spark, sf_dir):
    """A fetched wide frame with two-level columns as long records; NaN becomes NULL."""
    return series.generation_long(
        _fetched_frame(spark, sf_dir), "hour_start_utc",
        {"solar_mw": ("Solar", ""), "nuclear_mw": ("Hydro Pumped Storage", "Actual Consumption")},
    )


def _fetched_frame(spark, sf_dir) -> DataFrame:
    gap = lambda c: F.when(F.col(c) != 0, F.col(c)).otherwise(F.lit(float("nan"))).alias(c)
    wide = fr.generation_hourly(spark, sf_dir).filter("market_id = 'RO'")
    return wide.select("hour_start_utc", gap("solar_mw"), gap("nuclear_mw"))


@query(
    sql(
        """SELECT hour_start_utc AS timestamp_utc, CASE WHEN solar_mw <> 0 THEN solar_mw END AS actual_load_mw
FROM mix WHERE market_id = 'RO' AND CAST(hour_start_utc AS DATE) = DATE '2024-10-27'""",
        "mix",
    )
)
def load_frame_day(spark, sf_dir):
    """First value column of a fetched frame, cut to one UTC day."""
    frame = series.load_series(_fetched_frame(spark, sf_dir), "hour_start_utc")
    return series.on_utc_day(frame, date(2024, 10, 27))


@query(
    """SELECT event_id, CAST(ts AS DATE) AS date, CASE WHEN CAST(ts AS DATE) < DATE '2024-01-20' THEN 'REALIZED'
  ELSE 'FORECAST' END AS data_type FROM events"""
)
def weather_day_tags(spark, sf_dir):
    """Day and kind of each hour, as of a given date."""
    hours = table(spark, sf_dir, "events").select("event_id", "ts")
    return series.weather_days(hours, date(2024, 1, 20), "ts").drop("ts")


# ---- exchange-rate files -----------------------------------------------------------------

_DASHED = "CAST(floor(rate) AS BIGINT) % 7 = 0"


def rate_xml(spark, sf_dir) -> DataFrame:
    """One central-bank XML per day; some rates are a dash, yen are quoted per hundred."""
    written = F.when(F.floor("rate") % 7 == 0, "-").otherwise(F.col("rate").cast("string"))
    element = F.concat(
        F.lit('<Rate currency="'), "currency", F.lit('"'),
        F.when(F.col("currency") == "JPY", ' multiplier="100"').otherwise(""), F.lit(">"), written, F.lit("</Rate>"),
    )
    return fr.currency_rates(spark, sf_dir).groupBy("date").agg(lines(element, "currency").alias("_rates"))


def cube(namespace: str = ' xmlns="http://www.bnr.ro/xsd"') -> Column:
    day = F.date_format("date", "yyyy-MM-dd")
    return F.concat(F.lit(f'<Cube{namespace} date="'), day, F.lit('">\n'), "_rates", F.lit("\n</Cube>"))


@query(
    sql(
        f"""SELECT date, currency AS foreign_currency, rate AS rate_ron, CASE currency WHEN 'JPY' THEN 100 ELSE 1 END
  AS multiplier, 'https://www.bnr.ro/files/xml/years/nbrfxrates' || year(date) || '.xml' AS source_url
FROM currency_rates WHERE NOT ({_DASHED})""",
        "currency_rates",
    )
)
def xml_rates(spark, sf_dir):
    """Rates parsed from daily central-bank files."""
    files = rate_xml(spark, sf_dir).select(
        F.format_string("file:/land/landing/bnr_fx_rates/2000/%s.xml", F.col("date").cast("string")).alias("path"),
        F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n'), cube()).alias("value"),
    )
    return rates.parse_bnr(files)


def written_files(texts: DataFrame, name: str) -> str:
    """A folder with one text file per year."""
    spark = texts.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    landing.write_slices(texts, path, ["year"])
    return path


@query(
    sql(
        f"""SELECT date, currency AS foreign_currency, rate AS rate_ron, CASE currency WHEN 'JPY' THEN 100 ELSE 1 END
  AS multiplier, 'archive ' || year(date) AS source_url
FROM currency_rates WHERE NOT ({_DASHED})""",
        "currency_rates",
    )
)
def xml_archive(spark, sf_dir):
    """Yearly archives split into days, landed with a sidecar, and parsed."""
    archives = rate_xml(spark, sf_dir).groupBy(F.year("date").alias("year")).agg(
        F.array_join(F.sort_array(F.collect_list(cube(""))), "\n").alias("_days")
    ).select(
        "year",
        F.concat(F.lit('<DataSet xmlns="http://www.bnr.ro/xsd"><Body>'), "_days", F.lit("</Body></DataSet>")).alias("value"),
    )
    days = rates.split_bnr_archive(spark, written_files(archives, "archives"))
    stem = F.format_string("file:/land/landing/bnr_fx_rates/2000/%s", F.col("date").cast("string"))
    note = F.to_json(F.struct(F.format_string("archive %d", F.year("date")).alias("source_url")))
    return rates.parse_bnr(
        days.select(F.concat(stem, F.lit(".xml")).alias("path"), "value"),
        days.select(F.concat(stem, F.lit(".json")).alias("path"), note.alias("value")),
    )


@query(
    sql(
        """SELECT date, currency AS quote_currency, rate, DATE '2002-01-01' AS source_file_date FROM currency_rates""",
        "currency_rates",
    )
)
def json_rates(spark, sf_dir):
    """Rates parsed from daily JSON maps."""
    daily = fr.currency_rates(spark, sf_dir).withColumnRenamed("currency", "quote_currency")
    files = rates.ecb_day_files(daily, "http://history", F.lit("2002-01-01T05:00:00+00:00"))
    return rates.parse_ecb(files.select(F.lit("file:/land/x.json").alias("path"), "value"))


@query(
    sql(
        f"""SELECT date, currency AS quote_currency, rate FROM currency_rates WHERE NOT ({_DASHED})""",
        "currency_rates",
    )
)
def xml_history(spark, sf_dir):
    """Rates parsed from nested history files, one per year."""
    written = F.when(F.floor("rate") % 7 == 0, "N/A").otherwise(F.col("rate").cast("string"))
    element = F.concat(F.lit('<Cube currency="'), "currency", F.lit('" rate="'), written, F.lit('"/>'))
    days = fr.currency_rates(spark, sf_dir).groupBy("date").agg(lines(element, "currency").alias("_rates"))
    day = F.concat(F.lit('<Cube time="'), F.col("date").cast("string"), F.lit('">'), "_rates", F.lit("</Cube>"))
    years = days.groupBy(F.year("date").alias("year")).agg(
        F.array_join(F.sort_array(F.collect_list(day)), "\n").alias("_days")
    )
    head = (
        '<gesmes:Envelope xmlns:gesmes="http://www.gesmes.org/xml/2002-08-01" '
        'xmlns="http://www.ecb.int/vocabulary/2002-08-01/eurofxref"><gesmes:subject>rates</gesmes:subject><Cube>'
    )
    files = years.select("year", F.concat(F.lit(head), "_days", F.lit("</Cube></gesmes:Envelope>")).alias("value"))
    return rates.parse_ecb_history(spark, written_files(files, "histories"))


# ---- landing zone ---------------------------------------------------------------------------


@query(
    """WITH slices AS (SELECT o_orderpriority AS source, CAST(o_orderdate AS DATE) AS date, count(*) AS value
  FROM orders GROUP BY 1, 2)
SELECT source, date, CAST(value AS VARCHAR) AS value FROM slices s WHERE NOT EXISTS (SELECT 1 FROM orders o
  WHERE o.o_orderstatus = 'F' AND o.o_orderpriority = s.source AND CAST(o.o_orderdate AS DATE) = s.date)"""
)
def new_slices(spark, sf_dir):
    """Slices that the landing zone does not hold yet."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("source"), F.col("o_orderdate").cast("date").alias("date"), "o_orderstatus"
    )
    slices = orders.groupBy("source", "date").agg(F.count("*").cast("string").alias("value"))
    present = orders.filter("o_orderstatus = 'F'")
    return landing.new_slices(slices, present, ["source", "date"])


@query(
    """SELECT doc_id, CAST(regexp_extract(source || '/' || (DATE '2024-01-01' + CAST(doc_id % 366 AS INTEGER)) || '.csv',
  '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS DATE) AS date, lang AS market_id FROM documents"""
)
def path_parts(spark, sf_dir):
    """Market and day read from a landing path."""
    day = F.date_add(F.lit(date(2024, 1, 1)), (F.col("doc_id") % 366).cast("int")).cast("string")
    path = F.concat_ws("/", F.lit("file:/land/landing/opcom_pzu"), "lang", "source", F.concat(day, F.lit(".csv")))
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    return files.select(
        "doc_id", landing.file_date().alias("date"), landing.path_market("opcom_pzu").alias("market_id")
    )


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS value FROM orders"""
)
def plain_number(spark, sf_dir):
    """Numbers as text; anything else, a Java suffix included, is NULL."""
    written = F.concat(F.col("o_totalprice").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "d").otherwise(" "))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.plain_number(written).alias("value"))


# ---- writers: texts, parsed, less what an earlier run has stored -------------------------


def _writer(name: str, parse, target: Table, day: str, cut: str) -> None:
    """Query ``name``: the rows that a run appends to a table that holds all before ``cut``."""

    def build(spark, sf_dir):
        rows = parse(spark, sf_dir)
        stored = rows.filter(F.col(day) < F.lit(cut).cast(rows.schema[day].dataType))
        return changes.new_observations(rows, stored, target.keys, target.values)

    build.__name__ = name
    kind = "DATE" if day.endswith("date") else "TIMESTAMP"
    query(f"SELECT * FROM ({ORACLES[parse.__name__]}) WHERE {day} >= {kind} '{cut}'")(build)


for _name, _parse, _table, _day, _cut in (
    ("ingest_prices", csv_prices, OPCOM_PRICES, "delivery_date", "1998-01-01"),
    ("ingest_generation", json_generation, ENTSOE_GENERATION, "timestamp_utc", "2024-10-27 00:00:00"),
    ("ingest_load", json_load, ENTSOE_LOAD, "timestamp_utc", "2024-10-27 00:00:00"),
    ("ingest_weather", json_weather, WEATHER, "timestamp_utc", "2024-10-27 00:00:00"),
    ("ingest_bnr_rates", xml_rates, BNR_RATES, "date", "1998-01-01"),
    ("ingest_ecb_rates", json_rates, ECB_RATES, "date", "1998-01-01"),
):
    _writer(_name, _parse, _table, _day, _cut)
