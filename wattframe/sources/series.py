"""Generation, load and weather files (JSON), and the frames they are cut from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import flat_type, plain_number
from ..operators.wide import melt
from .landing import path_market

WEATHER_VARIABLES = (
    "temperature_2m", "wind_speed_10m", "wind_speed_100m", "shortwave_radiation", "cloud_cover",
)
REALIZED, FORECAST = "REALIZED", "FORECAST"


def _records(files: DataFrame, fields: str) -> DataFrame:
    """One row per element of ``records``.

    Elements are taken as text first, so a bad one only spoils itself; a file
    that is not JSON has no elements.
    """
    elements = F.from_json("value", "records ARRAY<STRING>")["records"]
    return files.select(
        path_market("entsoe").alias("market_id"), F.explode(elements).alias("_text")
    ).withColumn("r", F.from_json("_text", fields))


def _amount(name: str) -> tuple[Column, Column]:
    """Value as double, and whether it is either a number or absent."""
    text = F.col(f"r.{name}")
    return plain_number(text), text.isNull() | plain_number(text).isNotNull()


def parse_generation(files: DataFrame) -> DataFrame:
    """(market_id, timestamp_utc, production_type, actual_mw); unusable records are skipped."""
    value, fits = _amount("actual_mw")
    when = F.col("r.timestamp_utc").try_cast("timestamp")
    return (
        _records(files, "timestamp_utc STRING, production_type STRING, actual_mw STRING")
        .filter(when.isNotNull() & F.col("r.production_type").isNotNull() & fits)
        .select(
            "market_id", when.alias("timestamp_utc"),
            F.col("r.production_type").alias("production_type"), value.alias("actual_mw"),
        )
    )


def parse_load(files: DataFrame) -> DataFrame:
    """(market_id, timestamp_utc, actual_load_mw); unusable records are skipped."""
    value, fits = _amount("actual_load_mw")
    when = F.col("r.timestamp_utc").try_cast("timestamp")
    return (
        _records(files, "timestamp_utc STRING, actual_load_mw STRING")
        .filter(when.isNotNull() & fits)
        .select("market_id", when.alias("timestamp_utc"), value.alias("actual_load_mw"))
    )


def _hourly_rows(hourly: str, variables: Sequence[str] = WEATHER_VARIABLES) -> Column:
    """Zip the parallel arrays; a short or absent array leaves NULLs."""
    empty = F.array().cast("array<string>")
    arrays = [F.coalesce(F.col(f"{hourly}.{v}"), empty).alias(v) for v in variables]
    times = F.coalesce(F.col(f"{hourly}.time"), empty)
    zipped = F.arrays_zip(times.alias("time"), *arrays)
    return F.slice(zipped, F.lit(1), F.size(times))


_HOURLY = ", ".join(f"{v}: ARRAY<STRING>" for v in ("time", *WEATHER_VARIABLES))
_WEATHER_FILE = (
    "location STRING, lat STRING, lon STRING, data_type STRING, source_url STRING, "
    f"hourly STRUCT<{_HOURLY}>"
)


def parse_weather(files: DataFrame) -> DataFrame:
    """One row per location and hour; files without a kind count as realized."""
    doc = files.select(
        path_market("weather").alias("market_id"),
        F.from_json("value", _WEATHER_FILE).alias("d"),
    )
    return (
        doc.select("market_id", "d", F.explode(_hourly_rows("d.hourly")).alias("h"))
        .select(
            "market_id",
            F.col("d.location").alias("location_name"),
            plain_number("d.lat").alias("lat"),
            plain_number("d.lon").alias("lon"),
            F.col("h.time").try_cast("timestamp").alias("timestamp_utc"),
            F.coalesce("d.data_type", F.lit(REALIZED)).alias("data_type"),
            *[plain_number(F.col(f"h.{v}")).alias(v) for v in WEATHER_VARIABLES],
            F.col("d.source_url").alias("source_url"),
        )
        .filter(F.col("timestamp_utc").isNotNull())
    )


def generation_long(
    wide: DataFrame, timestamp: str, columns: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Wide generation frame to (timestamp_utc, production_type, actual_mw).

    ``columns`` maps a column to its (type, subtype); NaN becomes NULL.
    """
    labels = F.create_map(
        *[part for c, (t, s) in columns.items() for part in (F.lit(c), flat_type(F.lit(t), F.lit(s)))]
    )
    long = melt(wide, [timestamp], list(columns), "_column", "actual_mw")
    return long.select(
        F.col(timestamp).alias("timestamp_utc"),
        F.element_at(labels, F.col("_column")).alias("production_type"),
        "actual_mw",
    )


def load_series(frame: DataFrame, timestamp: str) -> DataFrame:
    """The first value column as (timestamp_utc, actual_load_mw); NaN becomes NULL."""
    first = next(c for c in frame.columns if c != timestamp)
    return frame.select(
        F.col(timestamp).alias("timestamp_utc"),
        F.when(~F.isnan(first), F.col(first)).alias("actual_load_mw"),
    )


def on_utc_day(df: DataFrame, day: date, ts: str = "timestamp_utc") -> DataFrame:
    """Rows of one UTC calendar day, as an instant range the scan can use."""
    begin = F.lit(day).cast("timestamp")
    end = F.date_add(F.lit(day), 1).cast("timestamp")
    return df.filter((F.col(ts) >= begin) & (F.col(ts) < end))


def weather_days(hours: DataFrame, as_of: date, ts: str = "timestamp_utc") -> DataFrame:
    """Add the day each hour belongs to and whether it was realized on ``as_of``."""
    day = F.to_date(ts)
    return hours.withColumn("date", day).withColumn(
        "data_type", F.when(day < F.lit(as_of), REALIZED).otherwise(FORECAST)
    )
