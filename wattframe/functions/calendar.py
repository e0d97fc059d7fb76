"""Calendar attributes as Column expressions: no lookup table, no shuffle."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .time import as_column

# Romanian public holidays as (month, day).
FIXED_HOLIDAYS = (
    (1, 1), (1, 2), (1, 24), (5, 1), (6, 1), (8, 15), (11, 30), (12, 1), (12, 25), (12, 26),
)
# Holidays added by law from 2024 on.
HOLIDAYS_SINCE_2024 = ((1, 6), (1, 7))
# Days relative to Orthodox Easter Sunday.
EASTER_OFFSETS = (-2, 0, 1, 49, 50)


def season(day: Column | str) -> Column:
    month = F.month(as_column(day))
    return (
        F.when(month.isin(12, 1, 2), "Winter")
        .when(month.isin(3, 4, 5), "Spring")
        .when(month.isin(6, 7, 8), "Summer")
        .otherwise("Autumn")
    )


def orthodox_easter(year: Column | str) -> Column:
    """Orthodox Easter Sunday in the Gregorian calendar, for 1900 to 2099.

    It is the Sunday after the church's full moon, which falls a number of days
    after 21 March of the Julian calendar that repeats every 19 years.  The
    calendars lie 13 days apart over the whole supported span.  Another year
    fails the job instead of being wrong.
    """
    year = as_column(year)
    moon = (year % 19 * 19 + 15) % 30
    full_moon = F.date_add(F.make_date(year, F.lit(3), F.lit(21)), (moon + 13).cast("int"))
    return F.when(year.between(1900, 2099), F.next_day(full_moon, "Sun")).otherwise(
        F.raise_error(F.concat(F.lit("Easter rule covers 1900-2099, got "), year.cast("string")))
    )


def is_public_holiday(day: Column | str) -> Column:
    """Romanian public holiday flag."""
    day = as_column(day)

    def on(month_days: tuple) -> Column:
        return reduce(or_, [(F.month(day) == m) & (F.dayofmonth(day) == d) for m, d in month_days])

    from_easter = F.datediff(day, orthodox_easter(F.year(day)))
    return (
        on(FIXED_HOLIDAYS)
        | ((F.year(day) >= 2024) & on(HOLIDAYS_SINCE_2024))
        | from_easter.isin(*EASTER_OFFSETS)
    )


def weekday_number(day: Column | str) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return F.weekday(as_column(day)) + 1
