"""Carrying the last known value forward, and as-of lookup."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILLED = "FORWARD_FILLED"
SYNTHETIC = "SYNTHETIC"


def _up_to_here(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before_here(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def forward_fill(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Sequence[str],
    chunk: str | None = "month",
) -> DataFrame:
    """Replace NULLs by the last earlier non-NULL value of the same key.

    ``order`` must be unique per key.  A key is cut into time chunks of a
    ``date_trunc`` unit, filled independently; the value entering a chunk comes
    from a summary with one row per (key, chunk), so no task holds a whole key.
    With ``chunk=None`` one task walks one key, for keys bounded by a calendar or
    an ``order`` that is no time.
    """
    if chunk is None:
        walk = _up_to_here(Window.partitionBy(*keys).orderBy(order))
        filled = {c: F.last(c, ignorenulls=True).over(walk) for c in columns}
        return df.withColumns(filled)

    cells = df.withColumn("_chunk", F.date_trunc(chunk, F.col(order)))
    walk = _up_to_here(Window.partitionBy(*keys, "_chunk").orderBy(order))
    filled = {c: F.last(c, ignorenulls=True).over(walk) for c in columns}

    ends = cells.groupBy(*keys, "_chunk").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_in_{c}") for c in columns]
    )
    chunks = _before_here(Window.partitionBy(*keys).orderBy("_chunk"))
    entering = ends.withColumns(
        {f"_in_{c}": F.last(f"_in_{c}", ignorenulls=True).over(chunks) for c in columns}
    )
    joined = cells.withColumns(filled).alias("f").join(
        entering.withColumnsRenamed({k: f"_k_{k}" for k in (*keys, "_chunk")}),
        [F.col(f"f.{k}").eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, "_chunk")],
        "left",
    )
    return joined.select(
        *[
            F.coalesce(F.col(f"f.{c}"), F.col(f"_in_{c}")).alias(c) if c in columns else F.col(f"f.{c}")
            for c in df.columns
        ]
    )


def reconcile_rates(
    observations: DataFrame,
    pairs: DataFrame,
    start: date,
    end: date,
    latest: Sequence[str] = (),
) -> DataFrame:
    """One rate per day and pair: primary source, else secondary, else carried forward.

    ``observations``: (date, base_currency, quote_currency, source, rate).  They may
    hold several revisions of a date, pair and source; the greatest by the columns
    ``latest`` counts.  ``pairs``: see ``registry.required_pairs``.
    A pair enters the range with its last rate before ``start``, however old, so
    a day's rate does not depend on where the range begins; days before the first
    rate are left out.  Pass all observations up to ``end``.

    Revision, source and the days of the range meet in one aggregation, which
    combines before its shuffle; then a pair's calendar, one row per day, is walked.
    """
    pair = ["base_currency", "quote_currency"]

    priority = (
        F.when(F.col("source") == F.col("primary_source"), 1)
        .when(F.col("source") == F.col("secondary_source"), 2)
    )
    ranked = observations.join(F.broadcast(pairs), pair).withColumn("_priority", -priority).filter(
        F.col("_priority").isNotNull() & (F.col("primary_source") != SYNTHETIC)
    )
    seen = ranked.select(
        "date", *pair, "primary_source", F.struct("_priority", *latest, "rate", "source").alias("_seen"),
        F.lit(False).alias("_asked"),
    )
    days = pairs.select(
        F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"), *pair, "primary_source",
        F.lit(None).cast(seen.schema["_seen"].dataType).alias("_seen"), F.lit(True).alias("_asked"),
    )
    calendar = seen.unionByName(days).groupBy("date", *pair).agg(
        F.max("primary_source").alias("primary_source"), F.max("_seen").alias("_seen"), F.max("_asked").alias("_asked"),
    )
    walk = _up_to_here(Window.partitionBy(*pair).orderBy("date"))
    synthetic = F.col("primary_source") == SYNTHETIC
    return (
        calendar.withColumn("_last", F.last("_seen", ignorenulls=True).over(walk))
        .filter("_asked")
        .select(
            "date",
            *pair,
            F.when(synthetic, 1.0).otherwise(F.col("_last.rate")).alias("rate"),
            F.when(synthetic, SYNTHETIC)
            .when(F.col("_seen").isNull(), FILLED)
            .otherwise(F.col("_seen.source"))
            .alias("source"),
        )
        .filter(F.col("rate").isNotNull())
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    on: str,
    payload: Sequence[str],
    chunk: str = "day",
    salts: int = 4,
) -> DataFrame:
    """Attach to each left row the ``payload`` of the last right row with ``on`` <= its own.

    Both sides are cut into (key, time chunk) cells and each cell is walked once,
    so no pair of rows is ever formed.  A summary with one row per (key, chunk)
    supplies the right row in force when a chunk begins.  The left rows of a cell
    are dealt to ``salts`` tasks, and only the cell's right rows are copied; raise
    it, or shorten the chunk, for keys of very many rows a day.  Of several right rows
    with the same key and ``on`` the greatest payload is used.
    """
    value, cell = "_value", [*by, "_chunk"]
    trunc = F.date_trunc(chunk, F.col(on))

    points = (
        right.filter(F.col(on).isNotNull())
        .groupBy(*by, on)
        .agg(F.max(F.struct(*payload)).alias(value))
        .withColumn("_chunk", trunc)
    )
    last_in_chunk = points.groupBy(*cell).agg(F.max_by(value, on).alias(value))
    visited = left.select(*by, trunc.alias("_chunk")).distinct()
    before = _before_here(Window.partitionBy(*by).orderBy("_chunk"))
    entering = (
        visited.withColumn("_wanted", F.lit(True))
        .unionByName(last_in_chunk, allowMissingColumns=True)
        .groupBy(*cell)
        .agg(F.max("_wanted").alias("_wanted"), F.max(value).alias(value))
        .withColumn(value, F.last(value, ignorenulls=True).over(before))
        .filter(F.col("_wanted") & F.col(value).isNotNull())
        .select(*by, F.col("_chunk").alias(on), value, "_chunk")
    )

    known = (
        entering.withColumn("_side", F.lit(0))
        .unionByName(points.withColumn("_side", F.lit(1)).select(*by, on, value, "_chunk", "_side"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    # A hash and not a random number: a repeated task must deal its rows the same way.
    dealt = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int") if salts > 1 else F.lit(0)
    asked = left.select(
        *by, on, F.struct(*left.columns).alias("_row"),
        trunc.alias("_chunk"), F.lit(2).alias("_side"), dealt.alias("_salt"),
    )
    walk = _up_to_here(Window.partitionBy(*cell, "_salt").orderBy(on, "_side"))
    return (
        asked.unionByName(known, allowMissingColumns=True)
        .withColumn(value, F.last(value, ignorenulls=True).over(walk))
        .filter(F.col("_side") == 2)
        .select("_row.*", *[F.col(f"{value}.{c}").alias(c) for c in payload])
    )
