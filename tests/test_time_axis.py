"""Settlement axis against published counts and Python's own zone rules."""

from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from wattframe.functions import time as ft
from wattframe.operators.axis import date_spine, join_axis, peak_slot_range, settlement_axis
from wattframe.operators.zones import with_offsets, zone_spans
from wattframe.plans.dims import date_bounds

BUCHAREST = "Europe/Bucharest"
DAYS = {
    # day: (hours, slots, first and last peak slot)
    date(2026, 2, 1): (24, 96, 33, 80),
    date(2026, 6, 2): (24, 96, 33, 80),
    date(2026, 3, 29): (23, 92, 29, 76),
    date(2025, 10, 26): (25, 100, 37, 84),
}


@pytest.fixture(scope="module")
def axis(spark):
    days = spark.createDataFrame([(d, BUCHAREST) for d in DAYS], "date date, timezone string")
    return settlement_axis(days).cache()


def test_day_length_slots_and_peak_range(spark, axis):
    days = spark.createDataFrame([(d,) for d in DAYS], "d date")
    hours = {r.d: r.h for r in days.select("d", ft.day_length_hours("d", BUCHAREST).alias("h")).collect()}
    slots = {r.date_id: r.n for r in axis.groupBy("date_id").agg(F.count("*").alias("n")).collect()}
    peaks = {r.date_id: (r.first_peak, r.last_peak) for r in peak_slot_range(axis).collect()}
    for day, (length, count, first, last) in DAYS.items():
        key = ft.date_id_of(day)
        assert hours[day] == length
        assert slots[key] == count
        assert peaks[key] == (first, last)


def test_spring_skips_and_autumn_repeats_the_third_hour(axis):
    spring = axis.filter("date_id = 20260329").collect()
    assert not [r for r in spring if r.local_hour == 3]
    assert not [r for r in spring if r.is_repeated_hour]
    autumn = axis.filter("date_id = 20251026 AND local_hour = 3").orderBy("timestamp_utc").collect()
    assert len(autumn) == 8
    assert [r.is_repeated_hour for r in autumn] == [False] * 4 + [True] * 4
    assert [r.utc_offset_minutes for r in autumn] == [180] * 4 + [120] * 4
    assert [r.is_dst for r in autumn] == [True] * 4 + [False] * 4


def test_numbering_is_dense_and_instants_are_unique(axis):
    for row in axis.groupBy("date_id").agg(
        F.count("*").alias("n"),
        F.min("interval_of_day").alias("lo"),
        F.max("interval_of_day").alias("hi"),
        F.countDistinct("timestamp_utc").alias("instants"),
    ).collect():
        assert (row.lo, row.hi, row.instants) == (1, row.n, row.n)


@pytest.mark.parametrize(
    "zone", [BUCHAREST, "Europe/London", "America/New_York", "Asia/Kolkata", "America/St_Johns"]
)
def test_axis_equals_zoneinfo_over_a_year(spark, zone):
    spans = spark.createDataFrame(
        [(date(2025, 1, 1), date(2025, 12, 31), zone)], "start date, end date, timezone string"
    )
    rows = settlement_axis(date_spine(spans)).collect()
    tz, instant = ZoneInfo(zone), datetime(2025, 1, 1, tzinfo=ZoneInfo(zone)).astimezone(timezone.utc)
    stop = datetime(2026, 1, 1, tzinfo=ZoneInfo(zone)).astimezone(timezone.utc)
    got = {r.timestamp_utc: r for r in rows}
    assert len(got) == len(rows)
    previous_day, number, seen = None, 0, set()
    while instant < stop:
        local = instant.astimezone(tz)
        if local.date() != previous_day:
            previous_day, number, seen = local.date(), 0, set()
        number += 1
        row = got.pop(instant.replace(tzinfo=None))
        position = local.hour * 4 + local.minute // 15
        assert row.date_id == ft.date_id_of(local.date())
        assert row.interval_of_day == number
        assert row.local_time_id == position
        assert row.time_label == local.strftime("%H:%M")
        assert row.utc_offset_minutes == local.utcoffset().total_seconds() // 60
        assert row.is_dst == (local.dst() != timedelta(0))
        assert row.is_repeated_hour == (position in seen)
        assert row.is_hour_start == (local.minute == 0)
        seen.add(position)
        instant += timedelta(minutes=15)
    assert not got


def test_arithmetic_equals_the_axis_join(spark, axis):
    numbers = spark.range(1, 102).select(F.col("id").cast("int").alias("n"))
    days = spark.createDataFrame([(d, BUCHAREST) for d in DAYS], "d date, timezone string")
    slots = days.crossJoin(numbers)
    direct = slots.filter(ft.slot_exists("d", "n", F.col("timezone"))).select(
        "timezone", ft.date_id("d").alias("date_id"), "n",
        ft.slot_start_utc("d", "n", F.col("timezone")).alias("ts"),
    )
    joined = join_axis(
        slots.select("timezone", ft.date_id("d").alias("date_id"), F.col("n").alias("interval_of_day")),
        axis,
    ).select("timezone", "date_id", F.col("interval_of_day").alias("n"), F.col("timestamp_utc").alias("ts"))
    assert direct.count() == sum(n for _, n, _, _ in DAYS.values())
    assert direct.exceptAll(joined).isEmpty() and joined.exceptAll(direct).isEmpty()
    back = direct.select("n", ft.interval_of_day("ts", F.col("timezone")).alias("m"))
    assert back.filter("n != m").isEmpty()


def test_local_day_window_keeps_the_first_local_hours(spark):
    """The span runs from local midnight, not from UTC midnight."""
    hours = spark.range(-48, 72).select(
        F.timestamp_seconds(F.lit(1780444800) + F.col("id") * 3600).alias("ts")  # 2026-06-03 00:00 UTC
    )
    day = date(2026, 6, 3)
    kept = hours.filter(ft.within_local_days("ts", day, day, BUCHAREST))
    local = [r.l for r in kept.select(ft.local_time("ts", BUCHAREST).alias("l")).collect()]
    assert len(local) == 24 and {x.date() for x in local} == {day}


def test_empty_and_reversed_spine(spark):
    assert date_spine(date_bounds(spark, date(2026, 1, 2), date(2026, 1, 1))).isEmpty()
    assert date_spine(date_bounds(spark, date(2026, 1, 1), date(2026, 1, 1))).count() == 1


def test_local_hour_start_in_a_half_hour_zone(spark):
    df = spark.sql("SELECT timestamp'2026-01-01 10:50:30' ts")
    row = df.select(
        ft.local_hour_start_utc("ts", "Asia/Kolkata").alias("a"),
        ft.local_hour_start_utc("ts", BUCHAREST).alias("b"),
    ).first()
    assert row.a == datetime(2026, 1, 1, 10, 30) and row.b == datetime(2026, 1, 1, 10, 0)


def test_offsets_of_every_kind_of_zone(spark):
    named = ("Europe/Berlin", "Europe/Dublin", "Europe/Moscow", "Africa/Casablanca", "Asia/Kolkata", "America/New_York")
    spans = zone_spans(spark, named, date(2009, 1, 1), date(2026, 12, 31))
    moments = [datetime(2010, 1, 1) + timedelta(hours=37 * i) for i in range(3900)]
    moments += [datetime(2014, 10, 25, 21, 59, 59), datetime(2014, 10, 25, 22), datetime(2011, 3, 26, 23), datetime(2026, 3, 29, 0, 59, 59), datetime(2026, 3, 29, 1)]
    asked = spark.createDataFrame([(z, m) for z in named for m in moments], "timezone string, timestamp_utc timestamp")
    for r in with_offsets(asked, spans).collect():
        local = r.timestamp_utc.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(r.timezone))
        assert r.offset_minutes == local.utcoffset().total_seconds() / 60, r
    of = {(r.timezone, r.timestamp_utc): (r.standard_minutes, r.is_dst) for r in with_offsets(
        spark.createDataFrame(
            [("Europe/Moscow", datetime(2010, 7, 1)), ("Europe/Moscow", datetime(2011, 12, 1)), ("Europe/Moscow", datetime(2015, 7, 1)),
             ("Europe/Dublin", datetime(2024, 1, 1)), ("Europe/Dublin", datetime(2024, 7, 1)), ("Africa/Casablanca", datetime(2024, 3, 20)),
             ("Africa/Casablanca", datetime(2024, 7, 1)), ("Asia/Kolkata", datetime(2024, 7, 1)), ("Nowhere", datetime(2024, 7, 1))],
            "timezone string, timestamp_utc timestamp",
        ), spans).collect()}
    assert of["Europe/Moscow", datetime(2010, 7, 1)] == (180, True)
    assert of["Europe/Moscow", datetime(2011, 12, 1)] == (240, False)
    assert of["Europe/Moscow", datetime(2015, 7, 1)] == (180, False)
    assert of["Europe/Dublin", datetime(2024, 1, 1)] == (60, True)
    assert of["Europe/Dublin", datetime(2024, 7, 1)] == (60, False)
    assert of["Africa/Casablanca", datetime(2024, 3, 20)] == (60, True)  # Ramadan
    assert of["Africa/Casablanca", datetime(2024, 7, 1)] == (60, False)
    assert of["Asia/Kolkata", datetime(2024, 7, 1)] == (330, False)
    assert of["Nowhere", datetime(2024, 7, 1)] == (None, None)
