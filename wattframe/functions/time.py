"""Instants, local calendar keys and settlement slots as Column expressions.

The instant (UTC) is the only key; local date, clock position and label are
attributes derived from it.  On the autumn changeover a local hour occurs twice,
so a (date_id, time_id) pair is never used to identify a row.

A zone argument is a zone name, a Column holding one, or ``Zones``, so a frame
with rows from several markets is handled in a single pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT_MINUTES = 15
SLOTS_PER_HOUR = 60 // SLOT_MINUTES
SLOT_SECONDS = SLOT_MINUTES * 60


@dataclass(frozen=True)
class Zones:
    """A zone column together with the names it is known to hold.

    With a literal zone Spark resolves the rules once per task; with a column it
    looks them up for every row.  Each known name gets its own literal branch,
    any other name still works through the column.  The names are those of the
    registry, so there are at most as many branches as time zones.
    """

    column: str
    names: tuple[str, ...]

    def convert(self, how: Callable[[Column, str | Column], Column], ts: Column) -> Column:
        column = F.col(self.column)
        result = how(ts, column)
        for name in self.names:
            result = F.when(column == name, how(ts, name)).otherwise(result)
        return result


Zone = Column | str | Zones


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def date_id(day: Column | str) -> Column:
    """YYYYMMDD as int."""
    day = as_column(day)
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def date_id_of(day: date) -> int:
    """YYYYMMDD of a Python date, for literal predicates."""
    return int(day.strftime("%Y%m%d"))


def local_time(ts: Column | str, tz: Zone) -> Column:
    """Wall clock in ``tz`` of the UTC instant ``ts``."""
    if isinstance(tz, Zones):
        return tz.convert(F.from_utc_timestamp, as_column(ts))
    return F.from_utc_timestamp(as_column(ts), tz)


def instant(local: Column | str, tz: Zone) -> Column:
    """UTC instant of a wall clock; the first pass where it occurs twice."""
    if isinstance(tz, Zones):
        return tz.convert(F.to_utc_timestamp, as_column(local))
    return F.to_utc_timestamp(as_column(local), tz)


def local_midnight_utc(day: Column | str, tz: Zone) -> Column:
    """The instant at which the local day begins."""
    return instant(as_column(day).cast("timestamp"), tz)


def day_length_hours(day: Column | str, tz: Zone) -> Column:
    """23, 24 or 25 in a zone with hourly daylight saving."""
    day = as_column(day)
    begin = local_midnight_utc(day, tz)
    end = local_midnight_utc(F.date_add(day.cast("date"), 1), tz)
    return (F.unix_timestamp(end) - F.unix_timestamp(begin)) / F.lit(3600.0)


def slots_in_day(day: Column | str, tz: Zone) -> Column:
    """92, 96 or 100 quarter hours."""
    return (day_length_hours(day, tz) * SLOTS_PER_HOUR).cast("int")


def slot_start_utc(day: Column | str, interval: Column | str, tz: Zone) -> Column:
    """Instant of the ``interval``-th (1-based) elapsed slot of a local day.

    Slots are numbered by elapsed time since local midnight, so the instant is
    plain arithmetic and needs no lookup table.  Pair it with ``slot_exists``.
    """
    offset = (as_column(interval).cast("long") - 1) * SLOT_SECONDS
    return F.timestamp_seconds(F.unix_timestamp(local_midnight_utc(day, tz)) + offset)


def slot_exists(day: Column | str, interval: Column | str, tz: Zone) -> Column:
    """Whether the local day has a slot with this number."""
    interval = as_column(interval)
    return (interval >= 1) & (interval <= slots_in_day(day, tz))


def interval_of_day(ts: Column | str, tz: Zone) -> Column:
    """1-based elapsed slot of the local day that ``ts`` falls into."""
    ts = as_column(ts)
    midnight = local_midnight_utc(F.to_date(local_time(ts, tz)), tz)
    elapsed = F.unix_timestamp(ts) - F.unix_timestamp(midnight)
    return (F.floor(elapsed / SLOT_SECONDS) + 1).cast("int")


def clock_position(local: Column | str) -> Column:
    """0-95 position on the wall clock: a label, not a key."""
    local = as_column(local)
    return (F.hour(local) * SLOTS_PER_HOUR + F.floor(F.minute(local) / SLOT_MINUTES)).cast("int")


def clock_label(local: Column | str) -> Column:
    return F.date_format(as_column(local), "HH:mm")


def utc_offset_minutes(ts: Column | str, tz: Zone) -> Column:
    ts = as_column(ts)
    return ((F.unix_timestamp(local_time(ts, tz)) - F.unix_timestamp(ts)) / 60).cast("int")


def is_dst(ts: Column | str, tz: Zone, standard: Column | None = None) -> Column:
    """Whether the offset differs from the zone's standard offset.

    Without ``standard`` (minutes) it is the smaller of the offsets on 1 January
    and 1 July of the local year.  That holds for zones whose summer time lies
    ahead of standard time; a zone with a negative winter shift needs it given.
    """
    ts = as_column(ts)
    if standard is not None:
        return utc_offset_minutes(ts, tz) != standard
    year = F.year(local_time(ts, tz))
    january = F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp")
    july = F.make_date(year, F.lit(7), F.lit(1)).cast("timestamp")
    standard = F.least(utc_offset_minutes(january, tz), utc_offset_minutes(july, tz))
    return utc_offset_minutes(ts, tz) > standard


def is_repeated(ts: Column | str, tz: Zone) -> Column:
    """Second pass through a local hour that occurs twice.

    Converting an ambiguous wall clock back to UTC resolves to the first pass,
    so an instant later than its own round trip belongs to the second.
    """
    ts = as_column(ts)
    return instant(local_time(ts, tz), tz) < ts


def hour_start_utc(ts: Column | str) -> Column:
    return F.date_trunc("hour", as_column(ts))


def local_hour_start_utc(ts: Column | str, tz: Zone) -> Column:
    """First instant of the local hour; equals the UTC hour for whole-hour offsets."""
    ts = as_column(ts)
    local = local_time(ts, tz)
    into_hour = F.minute(local) * 60 + F.second(local)
    return F.timestamp_seconds(F.unix_timestamp(ts) - into_hour)


def within_local_days(ts: Column | str, start: date, end: date, tz: str) -> Column:
    """Exact instants of the local days [start, end].

    Both bounds fold to literals, so the predicate reaches the Parquet scan.
    """
    ts = as_column(ts)
    lower = local_midnight_utc(F.lit(start), tz)
    upper = local_midnight_utc(F.lit(end + timedelta(days=1)), tz)
    return (ts >= lower) & (ts < upper)


def with_local_keys(df: DataFrame, tz: Zone, ts: str = "timestamp_utc") -> DataFrame:
    """Add local_ts, date_id, time_id (hour-start position) and hour_start_utc.

    The hour is the local one, so that date and position are the same in all of
    it, also where a zone is half an hour off.
    """
    into_hour = F.minute("local_ts") * 60 + F.second("local_ts")
    return df.withColumn("local_ts", local_time(ts, tz)).withColumns(
        {
            "date_id": date_id("local_ts"),
            "time_id": (F.hour("local_ts") * SLOTS_PER_HOUR).cast("int"),
            "hour_start_utc": F.timestamp_seconds(F.unix_timestamp(as_column(ts)) - into_hour),
        }
    )


def iso_utc(ts: Column | str) -> Column:
    """Naive-UTC ISO text without fraction."""
    return F.date_format(as_column(ts), "yyyy-MM-dd'T'HH:mm:ss")
