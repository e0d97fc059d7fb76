"""Currency arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .time import as_column


def per_unit_rate(rate: Column | str, multiplier: Column | str) -> Column:
    """Rate for one unit where the source quotes it per ``multiplier`` units."""
    return as_column(rate) / as_column(multiplier)


def convert(amount: Column | str, rate: Column | str) -> Column:
    """``amount / rate``; NULL where the rate is missing or zero."""
    rate = as_column(rate)
    return F.when(rate.isNotNull() & (rate != 0), as_column(amount) / rate)
