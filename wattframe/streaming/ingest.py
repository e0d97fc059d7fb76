"""New landing files to Bronze as a file stream, changes by kept state, and hourly means over late data."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans import bronze
from ..schemas import Table, conform


def landing_stream(spark: SparkSession, pattern: str, files_per_batch: int = 10_000) -> DataFrame:
    """Whole landing files as they appear: (path, value)."""
    return (
        spark.readStream.format("text")
        .option("wholetext", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(pattern)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )


def append_stream(
    files: DataFrame,
    parse: Callable[[DataFrame], DataFrame],
    table: Table,
    base: str,
    checkpoint: str,
    prune: str,
) -> StreamingQuery:
    """Parse what has arrived and append the new observations, then stop.

    A batch repeated after a failure finds its rows already stored and adds
    nothing, so the append needs no transaction.
    """

    def store(batch: DataFrame, _epoch: int) -> None:
        stamp = datetime.now(timezone.utc).replace(tzinfo=None)
        rows = conform(parse(batch).withColumn("ingested_at", F.lit(stamp)), table)
        bronze.append(rows, table, base, prune)

    return (
        files.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def changed_observations(
    readings: DataFrame, keys: Sequence[str], values: Sequence[str], ts: str, order: Sequence[str] = (),
    lateness: timedelta = timedelta(days=7), compare: str = "latest",
) -> DataFrame:
    """The readings of a stream that change something, by state kept across batches; NULL equals NULL.

    ``compare="latest"`` keeps the last value of every key and drops readings that repeat it; a value that returns to an
    earlier state passes.  A batch's readings of a key count in order of ``ts`` and the columns ``order``.  A key's state
    goes when the watermark is ``lateness`` past its last reading, so the state follows the live keys and not
    the stream's age; the next reading then counts as new.  A task holds the readings of one key and batch, which the
    source's batch size bounds (``maxFilesPerTrigger``).

    ``compare="any"`` keeps every (key, value) tuple for ``lateness`` and drops readings that repeat one.
    """
    if compare == "any":
        marked = readings.withWatermark(ts, f"{int(lateness.total_seconds())} seconds")
        return marked.dropDuplicatesWithinWatermark([*keys, *values])
    if compare != "latest":
        raise ValueError(f"compare must be 'any' or 'latest', not {compare!r}")
    exact = {"ignoreNullFields": "false", "timestampFormat": _EXACT + "XXX", "timestampNTZFormat": _EXACT}
    place = [f"_o{i}" for i in range(len(order))]
    packed = readings.withWatermark(ts, f"{int(lateness.total_seconds())} seconds").select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"),
        *[F.col(c).alias(p) for c, p in zip(order, place)], F.to_json(F.struct(*values), exact).alias("_value"),
        F.to_json(F.struct(*readings.columns), exact).alias("_row"), F.col(ts).alias("_ts"),
    )
    wait = int(lateness.total_seconds() * 1000)

    def step(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["_us", *place], kind="stable")
        last, seen = state.get if state.exists else (None, 0)
        changed = rows["_value"] != rows["_value"].shift(1)
        changed.iloc[0] = rows["_value"].iloc[0] != last
        yield rows.loc[changed.to_numpy(), ["_row"]]
        seen = max(seen, int(rows["_us"].max()))
        state.update((rows["_value"].iloc[-1], seen))
        state.setTimeoutTimestamp(max(seen // 1000, state.getCurrentWatermarkMs()) + wait)

    stepped = packed.groupBy(*[f"_k{i}" for i in range(len(keys))]).applyInPandasWithState(
        step, "_row string", "value string, seen long", "append", GroupStateTimeout.EventTimeTimeout
    )
    return stepped.select(F.from_json("_row", readings.schema, exact).alias("r")).select("r.*")


_EXACT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def to_folder(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived to Parquet files, each row once also after a restart, then stop."""
    return (
        rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def hourly_means(
    readings: DataFrame, ts: str, keys: Sequence[str], value: str, lateness: str = "7 days"
) -> DataFrame:
    """Mean per UTC hour; an hour stays open to late rows for ``lateness``."""
    hour = F.window(ts, "1 hour")
    return (
        readings.withWatermark(ts, lateness)
        .groupBy(hour, *keys)
        .agg(F.avg(value).alias(value), F.count(value).alias("readings"))
        .select(F.col("window.start").alias("hour_start_utc"), *keys, value, "readings")
    )
