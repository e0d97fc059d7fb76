"""Append-only tables whose history is stored by key, so that finding what is new never shuffles it.

The files lie in month folders, and in each month in a fixed number of buckets by the hash of the whole key, sorted
by key.  Spark takes the buckets as the partitioning that the anti join needs: only the batch is exchanged, into
as many tasks as there are buckets, and each task reads its bucket of the months that the batch spans.  Rows that are
appended leave the join in those same tasks, so they are written without another exchange, one file a bucket and month.

The number of buckets is fixed when a table is created, by a marker beside its months.  Choose it so that a bucket of a
month fits a task; with another number a table is refused.  The catalog entry is made from the path in every session and describes the folder only;
any Parquet reader can read it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from hashlib import md5
from operator import and_
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .latest import latest_per_key
from .store import MONTH, Folders, month_of_value, table_exists, with_month


def _registered(
    spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int, month_of: str
) -> str:
    """Name of the session's catalog entry for the folder ``path``."""
    if not Folders(spark, path).exists(f"{path}/_buckets-{buckets}"):
        raise ValueError(f"the table at {path!r} was not created with {buckets} buckets")
    listed = ", ".join(f"`{c}`" for c in keys)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != MONTH)
    spec = f"({columns}, {MONTH} int) USING parquet PARTITIONED BY ({MONTH}) CLUSTERED BY ({listed}) SORTED BY ({listed}) INTO {buckets} BUCKETS"
    name = f"bucketed_{md5(f'{path} {month_of} {spec}'.encode()).hexdigest()}"
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} {spec} LOCATION '{place}'")
    if spark.conf.get("spark.sql.catalogImplementation", "in-memory") == "hive":
        spark.catalog.recoverPartitions(name)
    spark.catalog.refreshTable(name)
    return name


def read_buckets(
    spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int, month_of: str,
    span: tuple[Any, Any] | None = None,
) -> DataFrame:
    """The table as Spark knows it to be bucketed; with ``span`` only rows between two values of ``month_of``."""
    rows = spark.table(_registered(spark, path, schema, keys, buckets, month_of))
    if span is not None:
        low, high = span
        rows = rows.filter(F.col(MONTH).between(month_of_value(low), month_of_value(high)))
        rows = rows.filter(F.col(month_of).between(F.lit(low), F.lit(high)))
    return rows.select(*[f.name for f in schema if f.name != MONTH])


def new_in_buckets(
    incoming: DataFrame, history: DataFrame, keys: Sequence[str], values: Sequence[str], compare: str = "any",
) -> DataFrame:
    """``changes.new_observations`` against a history from ``read_buckets``, which isn't exchanged.

    Keys are compared as they are, so that the buckets serve the join, and must not be NULL; NULL values are equal.
    """
    if compare == "latest":
        history = latest_per_key(history, keys, tiebreak=values)
    elif compare != "any":
        raise ValueError(f"compare must be 'any' or 'latest', not {compare!r}")

    def tuple_of(side: str):
        return F.struct(*[F.col(f"{side}.{c}") for c in values])

    # A comparison of both sides in one expression does not become a key of the join, which the buckets lack.
    alike = F.array_contains(F.array(tuple_of("i")), tuple_of("s"))
    same = reduce(and_, [F.col(f"i.{c}") == F.col(f"s.{c}") for c in keys])
    stored = history.select(*keys, *values).hint("merge").alias("s")
    return incoming.alias("i").join(stored, same & alike, "left_anti")


def append_to_buckets(
    spark: SparkSession, df: DataFrame, path: str, keys: Sequence[str], values: Sequence[str], buckets: int,
    month_of: str, compare: str = "any",
) -> int:
    """Append the rows whose (key, value) tuple is not stored yet; returns how many.  Creates the table if needed.

    Copies inside the batch are all kept.  Only the history between the least and the greatest ``month_of`` of the
    batch is read.
    """
    new = not table_exists(spark, path)
    if new:
        Folders(spark, path).make(f"{path}/_buckets-{buckets}")
    name = _registered(spark, path, df.schema, keys, buckets, month_of)
    if new:
        fresh = df.repartition(buckets, *keys)
    else:
        span = df.agg(F.min(month_of), F.max(month_of)).first()
        if span[0] is None:
            return 0
        history = read_buckets(spark, path, df.schema, keys, buckets, month_of, tuple(span))
        fresh = new_in_buckets(df, history, keys, values, compare)
    rows = Observation()
    columns = [*df.columns, MONTH]
    with_month(fresh, month_of).select(*columns).observe(rows, F.count(F.lit(1)).alias("rows")).write.insertInto(name)
    return rows.get["rows"]
