"""Day-ahead price exports (CSV with a preamble of varying length)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import locale_number, price_source_url, strip
from .landing import file_date, path_market

# Slot counts that identify a quarter-hourly and an hourly export.
QUARTER_HOURLY = (92, 100)
HOURLY = (23, 25)
# Fixed value: first cell of the header row that precedes the data rows.
HEADER_CELL = "Zona de tranzactionare"

_CELLS = 6
_BODY = rf"(?s)(?:^|\n)[^,\n]*{HEADER_CELL}[^,\n]*(?:,[^,\n]*){{{_CELLS - 1},}}\n(.*)"
_SEPARATOR = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
_ALL_QUOTED = r'^"[^"]*"(?:,"[^"]*")*$'


def _cells(line: Column) -> Column:
    """Split at commas outside quotes; drop quotes and surrounding blanks.

    A line whose cells are all quoted, as the exports write them, is cut between
    the quotes; only others need the search for commas outside quotes.
    """
    inside = line.substr(F.lit(2), F.length(line) - 2)
    plain = F.transform(F.split(inside, '","', -1), lambda cell: strip(cell))
    any_ = F.transform(F.split(line, _SEPARATOR, -1), lambda cell: strip(strip(strip(cell), '"')))
    return F.when(line.rlike(_ALL_QUOTED), plain).otherwise(any_)


def _slot(cells: Column) -> Column:
    return F.struct(
        cells[1].try_cast("int").alias("interval_15min"),
        locale_number(cells[2]).alias("price_lei_mwh"),
        locale_number(cells[3]).alias("volume_mw"),
        locale_number(cells[4]).alias("volume_buy_mw"),
        locale_number(cells[5]).alias("volume_sell_mw"),
    )


def _complete(slot: Column) -> Column:
    numbers = ("price_lei_mwh", "volume_mw", "volume_buy_mw", "volume_sell_mw")
    usable = slot["interval_15min"].isNotNull()
    for name in numbers:
        usable = usable & slot[name].isNotNull()
    return usable


def parse_price_files(files: DataFrame) -> DataFrame:
    """One row per file: market, day, usable slots, malformed rows, highest slot, verdict.

    A file is one delivery day, some hundred lines, and is handled inside its own
    row: header search, row parsing and the resolution check need no shuffle.

    The verdict goes by the highest slot number, so a day with a missing row is
    still recognised.  ``accepted``: quarter-hourly.  ``hourly``: the older
    format, whose numbers would be misread as quarter hours.  ``changed``:
    truncated download or new format.  ``empty``: no usable row.
    """
    lines = F.split(F.regexp_extract("value", _BODY, 1), r"\r?\n")
    rows = F.filter(
        F.transform(lines, _cells),
        lambda c: (F.size(c) >= _CELLS) & F.get(c, F.lit(1)).rlike("^[0-9]+$"),
    )
    highest = F.array_max(F.transform("slots", lambda s: s["interval_15min"]))
    # The generator keeps later filters from being pushed below the parsing,
    # which would make Spark parse every text once more for the filter.
    parsed = files.select("path", F.explode(F.array(F.transform(rows, _slot))).alias("_rows"))
    return (
        parsed.select(
            "path",
            path_market("opcom_pzu").alias("market_id"),
            file_date().alias("delivery_date"),
            F.filter("_rows", _complete).alias("slots"),
            (F.size("_rows") - F.size(F.filter("_rows", _complete))).alias("malformed_rows"),
        )
        .withColumn("highest", highest)
        .withColumn(
            "verdict",
            F.when(F.col("highest").isNull(), "empty")
            .when(F.col("highest").between(*QUARTER_HOURLY), "accepted")
            .when(F.col("highest").between(*HOURLY), "hourly")
            .otherwise("changed"),
        )
    )


def accepted_prices(days: DataFrame) -> DataFrame:
    """Slot rows of the accepted days."""
    return days.filter("verdict = 'accepted'").select(
        "market_id", "delivery_date", F.inline("slots")
    ).withColumn("source_url", price_source_url("delivery_date"))


def rejected_days(days: DataFrame) -> DataFrame:
    """Days refused as a whole, and why."""
    return days.filter(F.col("verdict").isin("hourly", "changed")).select(
        "market_id", "delivery_date", "highest", F.col("verdict").alias("reason")
    )


def malformed_counts(days: DataFrame) -> DataFrame:
    """Days with data rows that were dropped for an unreadable number."""
    return days.filter("malformed_rows > 0").select("market_id", "delivery_date", "malformed_rows")
