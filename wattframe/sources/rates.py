"""Exchange-rate files: central-bank XML, ECB JSON and ECB history XML.

Files with many days are read as text that ends where the next day's attribute begins, which lets Spark split a large
file among tasks; a record then holds one day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fx_archive_url, plain_number
from .landing import file_date

# Files written by an XML library may carry a namespace prefix on every tag.
_XML = {"ignoreNamespace": "true"}
_RATE = "ARRAY<STRUCT<_VALUE: STRING, _currency: STRING, _multiplier: STRING>>"
_CUBE = f"_date STRING, Rate {_RATE}, Cube STRUCT<_date: STRING, Rate: {_RATE}>"
_QUOTED = r"""["']([^"']*)["']"""


def day_records(spark: SparkSession, path: str, attribute: str) -> DataFrame:
    """(source_path, place, date, value) of every day in files of many days; ``place`` orders the days of a file.

    ``value`` is what follows ``attribute=`` up to the next one: the day, the rest of its tag, and its content.  What
    comes before the first day, and a day that is no date, is left out.
    """
    text = spark.read.option("lineSep", f"{attribute}=").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("source_path"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("place"),
        F.try_to_date(F.regexp_extract("value", rf"^\s*{_QUOTED}", 1)).alias("date"),
        "value",
    ).filter("date IS NOT NULL")


def parse_bnr(files: DataFrame, sidecars: DataFrame | None = None) -> DataFrame:
    """(date, foreign_currency, rate_ron, multiplier, source_url).

    The root is the day's element or contains it.  The date comes from the
    element, else from the file name.  Rates that are not numbers are skipped.
    The sidecar of equal name supplies the source address, else the yearly
    archive is given.
    """
    doc = files.select(
        F.regexp_replace("path", r"\.xml$", "").alias("_stem"),
        file_date().alias("_file_date"),
        F.from_xml("value", _CUBE, _XML).alias("d"),
    )
    rates = doc.select(
        "_stem", "_file_date",
        F.coalesce(F.try_to_date(F.coalesce("d._date", "d.Cube._date")), "_file_date").alias("date"),
        F.inline(F.coalesce("d.Rate", "d.Cube.Rate")),
    ).select(
        "_stem", "_file_date", "date",
        F.col("_currency").alias("foreign_currency"),
        plain_number("_VALUE").alias("rate_ron"),
        F.coalesce(F.col("_multiplier").try_cast("int"), F.lit(1)).alias("multiplier"),
    ).filter("foreign_currency <> '' AND rate_ron IS NOT NULL")

    known = F.lit(None).cast("string")
    if sidecars is not None:
        notes = sidecars.select(
            F.regexp_replace("path", r"\.json$", "").alias("_stem"),
            F.from_json("value", "source_url STRING")["source_url"].alias("_note"),
        )
        rates, known = rates.join(notes, "_stem", "left"), F.col("_note")
    return rates.select(
        "date", "foreign_currency", "rate_ron", "multiplier",
        F.coalesce(known, fx_archive_url("_file_date")).alias("source_url"),
    )


def split_bnr_archive(spark: SparkSession, path: str) -> DataFrame:
    """One (date, value, source_path) slice per day element of the yearly archives below ``path``.

    Of several elements for a date in one file the last one counts.
    """
    last = day_records(spark, path, "date").groupBy("source_path", "date").agg(F.max_by("value", "place").alias("value"))
    # (?s): the content goes over several lines; it ends with the first closing tag, whose prefix is the opening one's.
    whole = F.regexp_extract("value", r"(?s)^(.*?</(?:\w+:)?Cube>)", 1)
    prefix = F.regexp_extract("value", r"(?s)^.*?</((?:\w+:)?)Cube>", 1)
    return last.select("date", F.concat(F.lit("<"), prefix, F.lit("Cube date="), whole).alias("value"), "source_path")


def parse_ecb(files: DataFrame, today: Column | None = None) -> DataFrame:
    """(date, quote_currency, rate, source_file_date) from daily JSON files.

    The date in the body wins over the file name if it is valid.  The file date
    is the day of ``fetched_at``, else ``today``.  Bad rates are skipped.
    """
    today = F.current_date() if today is None else today
    doc = files.select(
        file_date().alias("_file_date"),
        F.from_json("value", "date STRING, fetched_at STRING, rates MAP<STRING, STRING>").alias("d"),
    )
    return (
        doc.select(
            F.coalesce(F.try_to_date("d.date"), "_file_date").alias("date"),
            F.coalesce(F.col("d.fetched_at").try_cast("timestamp").cast("date"), today).alias(
                "source_file_date"
            ),
            F.explode("d.rates").alias("quote_currency", "_rate"),
        )
        .withColumn("rate", plain_number("_rate"))
        .filter(F.col("rate").isNotNull())
        .select("date", "quote_currency", "rate", "source_file_date")
    )


def parse_ecb_history(spark: SparkSession, path: str) -> DataFrame:
    """(date, quote_currency, rate) from the history files below ``path``.

    Days without a usable rate do not appear.
    """
    def attribute(tag: Column, name: str) -> Column:
        return F.regexp_extract(tag, rf"\b{name}\s*=\s*{_QUOTED}", 1)

    tags = F.regexp_extract_all("value", F.lit(r"<(?:\w+:)?Cube\s([^>]*)>"), F.lit(1))
    return (
        day_records(spark, path, "time")
        .select("date", F.explode(tags).alias("_tag"))
        .select(
            "date", attribute(F.col("_tag"), "currency").alias("quote_currency"),
            plain_number(attribute(F.col("_tag"), "rate")).alias("rate"),
        )
        .filter("quote_currency <> '' AND rate IS NOT NULL")
    )


def ecb_day_files(rates: DataFrame, source_url: str, fetched_at: Column) -> DataFrame:
    """One JSON slice per day, in the form ``parse_ecb`` reads.

    A day has one rate per currency, a few dozen at most.
    """
    by_currency = F.map_from_entries(F.sort_array(F.collect_list(F.struct("quote_currency", "rate"))))
    return rates.groupBy("date").agg(by_currency.alias("rates")).select(
        "date",
        F.to_json(
            F.struct(
                F.date_format("date", "yyyy-MM-dd").alias("date"), "rates",
                F.lit(source_url).alias("source_url"), fetched_at.alias("fetched_at"),
            )
        ).alias("value"),
    )
