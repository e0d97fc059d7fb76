"""Daily price ranking and charge/discharge signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHARGE_SLOTS = 8
DISCHARGE_SLOTS = 8
CHARGE, IDLE, DISCHARGE = -1, 0, 1


def rank_slots(
    df: DataFrame, day: Sequence[str], price: str = "price_eur_mwh", ts: str = "timestamp_utc"
) -> DataFrame:
    """Add price_rank_asc, price_rank_desc and the day's lowest and highest price.

    Equal prices rank by instant.  A slot without a price has no rank.  The
    descending order is the exact reverse of the ascending one, so its rank is
    the number of priced slots minus the ascending rank plus one: one sort and
    one shuffle serve all four columns.

    ``ts`` is unique per day, so a window group holds one day's slots, at most 100.
    """
    whole = Window.partitionBy(*day)
    ascending = whole.orderBy(F.col(price).asc_nulls_last(), F.col(ts).asc())
    priced = F.col(price).isNotNull()
    windows = {
        "_rank": F.row_number().over(ascending),
        "_priced": F.count(price).over(whole),
        "daily_min_price_eur_mwh": F.min(price).over(whole),
        "daily_max_price_eur_mwh": F.max(price).over(whole),
    }
    ranks = {
        "price_rank_asc": F.when(priced, F.col("_rank")),
        "price_rank_desc": F.when(priced, (F.col("_priced") - F.col("_rank") + 1).cast("int")),
    }
    return df.withColumns(windows).withColumns(ranks).drop("_rank", "_priced")


def with_signals(
    df: DataFrame,
    day: Sequence[str],
    price: str = "price_eur_mwh",
    ts: str = "timestamp_utc",
    charge_slots: int = CHARGE_SLOTS,
    discharge_slots: int = DISCHARGE_SLOTS,
) -> DataFrame:
    """Rank the slots and mark the cheapest to charge, the dearest to discharge.

    Where both sets overlap, charging wins.  A slot without a price is idle.
    """
    signal = (
        F.when(F.col("price_rank_asc") <= charge_slots, CHARGE)
        .when(F.col("price_rank_desc") <= discharge_slots, DISCHARGE)
        .otherwise(IDLE)
    )
    spread = F.col("daily_max_price_eur_mwh") - F.col("daily_min_price_eur_mwh")
    return rank_slots(df, day, price, ts).withColumns(
        {"signal": signal, "arbitrage_spread_eur_mwh": spread}
    )
