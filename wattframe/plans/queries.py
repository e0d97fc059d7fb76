"""Read side: the questions asked of the Gold tables.

A market or date argument narrows the scan; left out, the query covers all.
An empty range gives an empty frame.  Reversed dates are a ``ValueError``.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import date_id_of
from ..operators.rank import CHARGE, DISCHARGE
from ..operators.runs import collapse_runs
from ..operators.usage import usage_summary as _usage_summary
from ..operators.wide import as_map
from ..registry import MARKETS, get_market
from .silver import Markets, with_market

# Generation columns shown at the top level and not per source.
TOP_LEVEL = (
    "date_id", "time_id", "market_id", "total_mw", "renewable_mw", "thermal_mw",
    "nuclear_mw_total", "renewable_share_pct",
)


def in_days(
    df: DataFrame, market_id: str | None = None, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Market and inclusive date range on the partition columns."""
    if start is not None and end is not None and end < start:
        raise ValueError(f"end {end} lies before start {start}")
    if market_id is not None:
        df = df.filter(F.col("market_id") == market_id)
    if start is not None:
        df = df.filter(F.col("date_id") >= date_id_of(start))
    if end is not None:
        df = df.filter(F.col("date_id") <= date_id_of(end))
    return df


def prices(
    price_hourly: DataFrame,
    market_id: str | None = None,
    start: date | None = None,
    end: date | None = None,
    markets: Markets = MARKETS,
) -> DataFrame:
    """Hourly prices with the settlement currency, in time order."""
    if market_id is not None:
        get_market(market_id, markets)
    rows = with_market(in_days(price_hourly, market_id, start, end), markets, "currency")
    return rows.select(
        "market_id", "currency", "hour_start_utc", "date_id", "time_id", "time_label",
        "price_local_mwh", "fx_rate", "price_eur_mwh", "is_peak", "is_repeated_hour",
    ).orderBy("market_id", "hour_start_utc")


def generation(
    generation_hourly: DataFrame,
    market_id: str | None = None,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """Hourly totals with a ``sources`` map of the per-type columns, in time order."""
    per_source = [
        c for c in generation_hourly.columns if c.endswith("_mw") and c not in TOP_LEVEL
    ]
    return (
        in_days(generation_hourly, market_id, start, end)
        .select("hour_start_utc", *TOP_LEVEL, as_map(per_source).alias("sources"))
        .orderBy("market_id", "hour_start_utc")
    )


def signals(
    bess_signals: DataFrame, market_id: str | None = None, day: date | None = None
) -> DataFrame:
    """All slots of a day in time order."""
    return in_days(bess_signals, market_id, day, day).orderBy("market_id", "timestamp_utc")


def _runs(bess_signals: DataFrame) -> DataFrame:
    """Runs of equal signal per market and day, idle ones included (``type`` NULL)."""
    slot = "timestamp_utc"
    runs = collapse_runs(
        bess_signals,
        ["market_id", "date_id"],
        slot,
        "signal",
        [
            F.min(slot).alias("start_utc"),
            F.min_by("time_id", slot).alias("start_time_id"),
            F.max_by("time_id", slot).alias("end_time_id"),
            F.min_by("time_label", slot).alias("start_label"),
            F.max_by("time_label", slot).alias("end_label"),
            F.avg("price_eur_mwh").alias("avg_price_eur_mwh"),
            F.count("*").alias("n_slots"),
            F.max("arbitrage_spread_eur_mwh").alias("arbitrage_spread_eur_mwh"),
        ],
    )
    kind = F.when(F.col("signal") == CHARGE, "charge").when(F.col("signal") == DISCHARGE, "discharge")
    return runs.withColumn("type", kind).drop("run_id", "signal")


def arbitrage_windows(
    bess_signals: DataFrame, market_id: str | None = None, day: date | None = None
) -> DataFrame:
    """Contiguous charge and discharge windows; idle slots end one and are not listed.

    Sort by ``start_utc``: the clock position is ambiguous on the autumn changeover.
    """
    return _runs(in_days(bess_signals, market_id, day, day)).filter("type IS NOT NULL")


def day_windows(
    bess_signals: DataFrame, market_id: str | None = None, day: date | None = None
) -> DataFrame:
    """One row per market and day: spread, and both kinds of window as lists.

    A day has at most 100 slots, so at most 50 windows of a kind.
    """
    window = F.struct(
        "start_utc", "start_time_id", "end_time_id", "start_label", "end_label",
        "avg_price_eur_mwh", "n_slots",
    )

    def windows_of(kind: str):
        return F.sort_array(F.collect_list(F.when(F.col("type") == kind, window)))

    runs = _runs(in_days(bess_signals, market_id, day, day))
    return runs.groupBy("market_id", "date_id").agg(
        F.max("arbitrage_spread_eur_mwh").alias("arbitrage_spread_eur_mwh"),
        windows_of("charge").alias("charge_windows"),
        windows_of("discharge").alias("discharge_windows"),
    )


def usage_summary(
    events: DataFrame, api_keys: DataFrame, days: int = 30, now: datetime | None = None
) -> DataFrame:
    """Use per key over the last ``days``; all of it for ``days=0``."""
    since = (now or datetime.now(timezone.utc).replace(tzinfo=None)) - timedelta(days=days) if days else None
    return _usage_summary(events, api_keys, since)
