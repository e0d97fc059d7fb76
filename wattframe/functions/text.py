"""Parsing and naming helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .time import as_column

_NUMBER = r"(?i)^[+-]?(\d+\.?\d*([e][+-]?\d+)?|\.\d+([e][+-]?\d+)?|nan|inf(inity)?)$"
# Blanks that a cell may be padded with, the no-break space included.
_BLANKS = " \t\n\r\f\v\u0085\u00a0"


def strip(text: Column | str, characters: str = _BLANKS) -> Column:
    """Trim blanks, or the given characters, from both ends."""
    return F.btrim(as_column(text), F.lit(characters))


def _number(cleaned: Column) -> Column:
    """The pattern guards the cast, which would also accept a trailing d or f."""
    return F.when(cleaned.rlike(_NUMBER), cleaned.try_cast("double"))


def plain_number(text: Column | str) -> Column:
    """Double of a number written with a decimal point; NULL for anything else."""
    return _number(strip(text))


def locale_number(text: Column | str) -> Column:
    """As ``plain_number``; a comma marks the decimals and dots then group digits."""
    cleaned = strip(text)
    swapped = F.translate(cleaned, ",.", ".")
    return F.when(F.contains(cleaned, F.lit(",")), _number(swapped)).otherwise(_number(cleaned))


def finite_or_null(value: Column | str) -> Column:
    """NaN becomes NULL."""
    value = as_column(value)
    return F.when(~F.isnan(value), value)


def integer_or_null(value: Column | str) -> Column:
    """Whole part as a 64-bit integer; NaN, infinity and what does not fit become NULL."""
    value = as_column(value).try_cast("double")
    return F.when(F.abs(value) < F.lit(2.0**63), value.cast("long"))


def slug(text: Column | str) -> Column:
    """Lower-case words joined by single underscores."""
    words = F.regexp_replace(F.lower(as_column(text)), "[^a-z0-9]+", "_")
    return F.regexp_replace(words, "^_+|_+$", "")


def megawatt_column(type_name: Column | str) -> Column:
    """Column name that the wide generation table uses for a production type."""
    return F.concat(slug(type_name), F.lit("_mw"))


def flat_type(name: Column | str, subtype: Column | str) -> Column:
    """``Type|SubType``, or the type alone where there is no subtype."""
    sub = as_column(subtype)
    return F.concat_ws("|", as_column(name), F.when(sub != "", sub))


def location_id(market: Column | str, location: Column | str) -> Column:
    """Six-digit id from the first 32 bits of an MD5: stable without a lookup."""
    digest = F.md5(F.concat(as_column(market), F.lit("::"), as_column(location)).cast("binary"))
    head = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return (head % 900000 + 100000).cast("int")


def price_source_url(day: Column | str) -> Column:
    """Export address of one delivery day."""
    return F.concat(
        F.lit("https://www.opcom.ro/rapoarte-pzu-raportPIP-export-csv/"),
        F.date_format(as_column(day), "dd/MM/yyyy"),
        F.lit("/ro?resolution=15"),
    )


def fx_archive_url(day: Column | str) -> Column:
    """Yearly archive that holds one day's central-bank rates."""
    return F.concat(
        F.lit("https://www.bnr.ro/files/xml/years/nbrfxrates"),
        F.year(as_column(day)).cast("string"),
        F.lit(".xml"),
    )
