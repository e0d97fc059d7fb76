import hashlib
from datetime import date

import pytest
from pyspark.sql import functions as F

from wattframe.functions import calendar as cal
from wattframe.functions import money, text
from wattframe.operators.axis import date_spine
from wattframe.plans.dims import date_bounds, dim_date
from wattframe.registry import mix_columns


def evaluate(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", fn("x").alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "written, number",
    [("81.5", 81.5), ("400", 400.0), ("2.047,5", 2047.5), ("19,25", 19.25),
     ("  46.125  ", 46.125), ("0", 0.0), ("-12,5", -12.5), ("", None), ("-", None),
     ("12d", None), ("1,2,3", None), (None, None)],
)
def test_locale_number(spark, written, number):
    assert evaluate(spark, [written], text.locale_number) == [number]


def test_plain_number_rejects_java_suffixes(spark):
    got = evaluate(spark, ["1.5", "1e3", "1.5f", "abc", " 2 "], text.plain_number)
    assert got == [1.5, 1000.0, None, None, 2.0]


def test_slug_and_wide_column_names_agree(spark):
    names = mix_columns()
    assert len(names) == 21
    assert names["Fossil Brown coal/Lignite"] == "fossil_brown_coal_lignite_mw"
    assert (
        names["Hydro Pumped Storage|Actual Aggregated"] == "hydro_pumped_storage_actual_aggregated_mw"
    )
    assert evaluate(spark, list(names), text.megawatt_column) == list(names.values())


def test_location_id_is_the_md5_rule(spark):
    names = ["Bucharest", "Dobrogea", "Iași", ""]
    got = evaluate(spark, names, lambda x: text.location_id(F.lit("RO"), x))
    assert got == [
        int(hashlib.md5(f"RO::{n}".encode()).hexdigest()[:8], 16) % 900000 + 100000 for n in names
    ]
    assert all(100000 <= i <= 999999 for i in got)


def test_flat_type(spark):
    df = spark.createDataFrame([("A", "B"), ("A", ""), ("A", None)], "t string, s string")
    assert [r[0] for r in df.select(text.flat_type("t", "s")).collect()] == ["A|B", "A", "A"]


def test_source_addresses(spark):
    row = spark.sql("SELECT date'2026-06-02' d").select(
        text.price_source_url("d"), text.fx_archive_url("d")
    ).first()
    assert row[0].endswith("/02/06/2026/ro?resolution=15")
    assert row[1].endswith("nbrfxrates2026.xml")


def test_easter(spark):
    got = evaluate(spark, [2023, 2024, 2025, 2026], cal.orthodox_easter, "int")
    assert got == [date(2023, 4, 16), date(2024, 5, 5), date(2025, 4, 20), date(2026, 4, 12)]
    years = list(range(1900, 2100))
    sundays = evaluate(spark, years, cal.orthodox_easter, "int")
    for year, sunday in zip(years, sundays):
        assert sunday.year == year and sunday.weekday() == 6
        assert date(year, 4, 3) <= sunday <= date(year, 5, 10)
    with pytest.raises(Exception, match="1900-2099"):
        evaluate(spark, [2100], cal.orthodox_easter, "int")


def test_calendar_dimension(spark):
    days = date_spine(date_bounds(spark, date(2023, 1, 1), date(2026, 12, 31)))
    rows = {r.full_date: r for r in dim_date(days).collect()}
    assert len(rows) == 1461
    for day, row in rows.items():
        iso = day.isocalendar()
        assert (row.day_of_week, row.week_of_year) == (iso.weekday, iso.week)
        assert row.quarter == (day.month - 1) // 3 + 1
        assert row.is_weekday == (iso.weekday <= 5)
        assert row.date_id == int(day.strftime("%Y%m%d"))
    holiday = {d for d, r in rows.items() if r.is_ro_holiday}
    assert date(2023, 1, 6) not in holiday and date(2024, 1, 6) in holiday
    assert {date(2024, 5, 3), date(2024, 5, 5), date(2024, 5, 6), date(2024, 6, 23), date(2024, 6, 24)} <= holiday
    assert len([d for d in holiday if d.year == 2024]) == 17
    assert rows[date(2024, 12, 1)].season == "Winter" and rows[date(2024, 9, 1)].season == "Autumn"


def test_currency_guards(spark):
    df = spark.createDataFrame([(10.0, 5.0), (10.0, 0.0), (10.0, None), (None, 5.0)], "a double, r double")
    assert [r[0] for r in df.select(money.convert("a", "r")).collect()] == [2.0, None, None, None]
    assert df.limit(1).select(money.per_unit_rate("a", F.lit(100))).first()[0] == 0.1


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(text.finite_or_null("x")).collect()] == [None, 1.0, None]
