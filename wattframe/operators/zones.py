"""The offset intervals of time zones as a table.

The rows come from the same zone database that Spark converts with, for the zones that are configured, some two a year
and zone.  They say which offset is the standard one at each time, which a zone's offsets alone do not: a country can
change its standard offset, or keep its summer time as the standard and go behind it in winter.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from ..registry import small_frame
from .fill import asof_join

#: Minutes of the legal standard time of zones that go behind it for part of the year.  The zone
#: database of the JVM describes them the other way round, as ahead of standard time for the rest of the year.
BEHIND_STANDARD = {"Africa/Casablanca": 60, "Africa/El_Aaiun": 60, "Europe/Dublin": 60}
#: Since when they do.
BEHIND_SINCE = {"Africa/Casablanca": date(2018, 10, 28), "Africa/El_Aaiun": date(2018, 10, 28), "Europe/Dublin": date(1971, 10, 31)}

_COLUMNS = "timezone string, timestamp_utc timestamp, offset_minutes int, standard_minutes int, is_dst boolean"


def zone_spans(spark: SparkSession, zones: Sequence[str], start: date, end: date) -> DataFrame:
    """``timezone, timestamp_utc, offset_minutes, standard_minutes, is_dst`` from each instant on, for instants of [start, end].

    A zone's first row begins a day before ``start``, so that local days of any zone are covered.
    """
    time = spark._jvm.java.time
    first = datetime.combine(start, datetime.min.time()) - timedelta(days=1)
    last = datetime.combine(end, datetime.min.time()) + timedelta(days=2)
    seconds = lambda at: int((at - datetime(1970, 1, 1)).total_seconds())
    rows = []
    for zone in sorted(set(zones)):
        rules, moment = time.ZoneId.of(zone).getRules(), seconds(first)
        while moment < seconds(last):
            at = time.Instant.ofEpochSecond(moment)
            offset, standard = rules.getOffset(at).getTotalSeconds() // 60, rules.getStandardOffset(at).getTotalSeconds() // 60
            if zone in BEHIND_STANDARD and datetime(1970, 1, 1) + timedelta(seconds=moment) >= datetime.combine(BEHIND_SINCE[zone], datetime.min.time()):
                standard = BEHIND_STANDARD[zone]
            begins = datetime(1970, 1, 1) + timedelta(seconds=moment)
            rows.append((zone, begins, offset, standard, offset != standard))
            change = rules.nextTransition(at)
            if change is None:
                break
            moment = change.getInstant().getEpochSecond()
    return small_frame(spark, rows, _COLUMNS)


def with_offsets(df: DataFrame, spans: DataFrame, ts: str = "timestamp_utc", zone: str = "timezone") -> DataFrame:
    """Add ``offset_minutes``, ``standard_minutes`` and ``is_dst`` of instants, joined as of; NULL outside of ``spans``."""
    named = spans.withColumnsRenamed({"timezone": zone, "timestamp_utc": ts})
    return asof_join(df, named, [zone], ts, ["offset_minutes", "standard_minutes", "is_dst"])
