"""Reading and writing partitioned Parquet tables addressed by path.

Appends go straight to the table.  Upserts and range replacement rewrite only the
partitions they touch, by Spark's dynamic partition overwrite: the new contents
are written to a staging folder, and only when that write is complete do they take
the place of the old folders.  A lost executor just repeats its tasks.  Partitions
that are not touched are neither read nor written.

A partition is a month (``month_of`` names the column it is derived from), so a
folder holds more than the rows of a day; the other days of a touched month are
kept.  The commit exchanges folder by folder and is not one transaction: a reader
that runs in that moment may miss a partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection, Iterable, Iterator, Sequence
from contextlib import contextmanager, nullcontext
from datetime import date
from functools import reduce
from operator import and_
from typing import Any
from urllib.parse import quote

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StructType

from .changes import merged_rows, new_observations
from .quality import duplicate_keys

Filter = tuple[str, str, Any]

#: Partition column of the month, for instance 202607; ``read_table`` does not return it.
MONTH = "month_id"


class TableNotFound(ValueError):
    """The table has not been written yet."""


class Folders:
    """The few file-system calls needed, through Spark's own Hadoop client."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def drop(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def glob(self, pattern: str) -> list[str]:
        return [status.getPath().toString() for status in self._fs.globStatus(self._path(pattern)) or []]


# ---- months ------------------------------------------------------------------------


def month_column(column: str, kind: DataType) -> Column:
    """The month of a date, an instant (in UTC) or a number such as 20260731."""
    if isinstance(kind, IntegralType):
        return F.floor(F.col(column) / 100).cast("int")
    return (F.year(column) * 100 + F.month(column)).cast("int")


def month_of_value(value: Any) -> int:
    return value.year * 100 + value.month if isinstance(value, date) else value // 100


def with_month(df: DataFrame, month_of: str | None) -> DataFrame:
    return df if month_of is None else df.withColumn(MONTH, month_column(month_of, df.schema[month_of].dataType))


def _levels(partitions: Sequence[str], month_of: str | None) -> list[str]:
    return [*partitions, *([] if month_of is None else [MONTH])]


# ---- tables ------------------------------------------------------------------------


def table_exists(spark: SparkSession, path: str) -> bool:
    return Folders(spark, path).exists(path)


def read_table(
    spark: SparkSession,
    path: str,
    filters: Iterable[Filter] = (),
    schema: StructType | str | None = None,
    month_of: str | None = None,
) -> DataFrame:
    """Scan a table; ``filters`` are (column, operator, value) and reach the scan.

    Operators: = == != > >= < <= in, not in.  With ``month_of``, filters on that
    column also choose the months.
    """
    df = _scan(spark, path, schema)
    for column, operator, value in filters:
        df = df.filter(_predicate(column, operator, value))
        if column == month_of and operator in _MONTH_TEST:
            df = df.filter(_predicate(MONTH, _MONTH_TEST[operator], month_of_value(value)))
    return df.drop(MONTH)


#: What a test of a value says about its month.
_MONTH_TEST = {"=": "=", "==": "==", ">": ">=", ">=": ">=", "<": "<=", "<=": "<="}


def _scan(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """The table with its month, if it has one."""
    if not table_exists(spark, path):
        raise TableNotFound(f"No table at {path!r}; run the job that builds it first.")
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        raise TableNotFound(f"The table at {path!r} has no rows yet; pass its schema.") from error


def _predicate(column: str, operator: str, value: Any):
    col = F.col(column)
    tests = {
        "=": lambda: col == value,
        "==": lambda: col == value,
        "!=": lambda: col != value,
        ">": lambda: col > value,
        ">=": lambda: col >= value,
        "<": lambda: col < value,
        "<=": lambda: col <= value,
        "in": lambda: col.isin(*value),
        "not in": lambda: ~col.isin(*value),
    }
    if operator not in tests:
        raise ValueError(f"unknown filter operator {operator!r}")
    return tests[operator]()


def write_table(
    df: DataFrame, path: str, partitions: Sequence[str] = (), mode: str = "overwrite", month_of: str | None = None,
) -> int:
    """Partitioned write; returns the number of rows, observed while writing.

    The rebalance hint groups rows by partition so that each folder gets few
    files, and lets the adaptive planner split a partition that is too large.
    ``mode="touched"`` overwrites the partitions that ``df`` has rows of.
    """
    rows, levels = Observation(), _levels(partitions, month_of)
    df = with_month(df, month_of)
    if levels:
        df = df.hint("rebalance", *levels)
    writer = df.observe(rows, F.count(F.lit(1)).alias("rows")).write.mode("overwrite" if mode == "touched" else mode)
    if levels:
        writer = writer.partitionBy(*levels)
    writer.option("partitionOverwriteMode", "dynamic" if mode == "touched" else "static").parquet(path)
    return rows.get["rows"]


@contextmanager
def staged(df: DataFrame, beside: str) -> Iterator[DataFrame]:
    """Write ``df`` once and read it back, so that several jobs can use it.

    The folder lies beside the table, which all executors reach.  Unlike cached blocks, the files outlive the
    executors; being Parquet, a later job reads only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{_parent(beside)}/_staging/batch-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        Folders(spark, path).drop(path)


def append_new_observations(
    spark: SparkSession,
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    values: Sequence[str],
    partitions: Sequence[str] = (),
    compare: str = "any",
    prune: str | None = None,
    span: tuple[Any, Any] | None = None,
    month_of: str | None = None,
) -> int:
    """Append the rows whose (key, value) tuple is not stored yet; returns how many.

    ``prune`` names a key column that rows are clustered by, such as the delivery
    date.  History outside the batch's span of that column is then not read, and
    the cost of a run no longer grows with the age of the table; with
    ``month_of=prune`` the files of other months are not opened.  ``span`` gives
    the bounds where the caller knows them; else a pass over the batch finds them.
    Of the first partition column only the batch's own values are read.
    """
    if not table_exists(spark, path):
        return write_table(df, path, partitions, month_of=month_of)
    history = _scan(spark, path, df.schema)
    own = [c for c in partitions[:1] if c in keys]
    bounds = [] if prune is None or span else [F.min(prune).alias("low"), F.max(prune).alias("high")]
    wanted = [*bounds, *[F.collect_set(c).alias("values") for c in own]]
    seen = df.agg(*wanted).first() if wanted else None
    if own:
        history = history.filter(F.col(own[0]).isNull() | F.col(own[0]).isin(seen["values"]))
    if prune is not None:
        low, high = span or (seen["low"], seen["high"])
        near = F.col(prune).isNull()
        if low is not None:
            near = near | F.col(prune).between(F.lit(low), F.lit(high))
            if month_of == prune:
                months = F.col(MONTH).between(month_of_value(low), month_of_value(high))
                history = history.filter(F.col(MONTH).isNull() | months)
        history = history.filter(near)
    fresh = new_observations(df, history.drop(MONTH), keys, values, compare)
    return write_table(fresh, path, partitions, mode="append", month_of=month_of)


def merge_upsert(
    spark: SparkSession,
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    partitions: Sequence[str] = (),
    key_fixes_partition: bool = False,
    month_of: str | None = None,
    settled: bool = False,
) -> int:
    """Update rows of equal key, insert the others; returns the rows of ``df``.  Creates the table if needed.

    A key that occurs twice in ``df`` is an error, in the first write too, because
    the result would depend on row order.  By default a key may sit in another
    partition than before, so the target's keys are searched everywhere; with
    ``key_fixes_partition`` only the batch's own partitions are read.  The batch is
    written once and read several times; ``settled`` says that it already is stored.
    """
    batch = with_month(df, month_of)
    with nullcontext(batch) if settled else staged(batch, path) as source:
        if not duplicate_keys(source.dropna(subset=list(keys)), keys).isEmpty():
            raise ValueError(f"several source rows share a key of {path}: {list(keys)}")
        levels = _levels(partitions, month_of)
        if not table_exists(spark, path):
            return write_table(source, path, levels)
        rows = Observation()
        counted = source.observe(rows, F.count(F.lit(1)).alias("rows"))
        if levels:
            _merge(spark, source, counted, path, keys, levels, key_fixes_partition)
        else:
            target = _scan(spark, path, source.schema)
            merged = merged_rows(target, source, keys, counted)
            with staged(merged, path) as whole:  # a table without partitions is replaced as a whole
                write_table(whole, path)
        return rows.get["rows"]


def _merge(
    spark: SparkSession,
    source: DataFrame,
    counted: DataFrame,
    path: str,
    keys: Sequence[str],
    levels: Sequence[str],
    key_fixes_partition: bool,
) -> None:
    """Rewrite the partitions that hold rows of ``source``, or held rows of its keys."""
    target = _scan(spark, path, source.schema)
    touched = source.select(*levels)
    if key_fixes_partition:
        write_table(_with_rest(target, touched, source, counted, keys, levels), path, levels, mode="touched")
        return
    matched = target.join(source.select(*keys), list(keys), "left_semi")
    with staged(touched.unionByName(matched.select(*levels)).distinct(), path) as touched:
        own = source.select(*levels).distinct()
        left = [r.asDict() for r in touched.join(own, _same(touched, own, levels), "left_anti").collect()]
        with _vacated(spark, [_folder(path, values) for values in left]):
            write_table(_with_rest(target, touched, source, counted, keys, levels), path, levels, mode="touched")


def _with_rest(
    target: DataFrame, touched: DataFrame, source: DataFrame, counted: DataFrame, keys: Sequence[str], levels: Sequence[str]
) -> DataFrame:
    """``source`` (``counted``, as it is written), and the other rows of the partitions that are touched."""
    return merged_rows(_around(target, touched.distinct(), levels), source, keys, counted)


def _around(target: DataFrame, touched: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Rows of the partitions that ``touched`` lists.

    The bounds of each partition column are literals, which prune the scan before
    the semi join picks the partitions.
    """
    bounds = touched.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in levels for f in (F.min, F.max)]).first()
    near = [
        F.col(c).isNull() | F.col(c).between(F.lit(bounds[f"min_{c}"]), F.lit(bounds[f"max_{c}"])) for c in levels
    ]
    close = target.filter(reduce(and_, near)).alias("t")
    return close.join(touched.alias("p"), _same_names("t", "p", levels), "left_semi")


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(and_, [left[c].eqNullSafe(right[c]) for c in columns])


def replace_date_range(
    spark: SparkSession,
    df: DataFrame,
    path: str,
    market_id: str | Collection[str],
    start_id: int,
    end_id: int,
    partitions: Sequence[str] = ("market_id",),
    month_of: str = "date_id",
) -> int:
    """Overwrite exactly the [start_id, end_id] days of one market, or of several; returns the rows written.

    Days of the range without rows in ``df`` are removed, the other days of the
    months it touches stay.  A row outside the range is an error and leaves the
    table unchanged.  A missing table is created from ``df`` as it is.
    """
    if not table_exists(spark, path):
        return write_table(df, path, partitions, month_of=month_of)
    markets = [market_id] if isinstance(market_id, str) else sorted(market_id)
    inside = F.coalesce(
        F.col("market_id").isin(markets) & F.col("date_id").between(start_id, end_id), F.lit(False)
    )
    stray = F.raise_error(F.concat(F.lit(_STRAY), F.to_json(F.struct("market_id", "date_id"))))
    rows = Observation()
    checked = df.withColumn("date_id", F.when(inside, F.col("date_id")).otherwise(stray.cast("int"))).observe(
        rows, F.count(F.lit(1)).alias("rows")
    )
    first, last = month_of_value(start_id), month_of_value(end_id)
    touched = _scan(spark, path, df.schema).filter(
        F.col("market_id").isin(markets) & F.col(MONTH).between(first, last)
    )
    kept = touched.filter(~inside).drop(MONTH)
    folders = [
        folder for market in markets for folder in Folders(spark, path).glob(_folder(path, {"market_id": market}) + f"/{MONTH}=*")
        if first <= int(folder.rsplit("=", 1)[1]) <= last
    ]
    with _vacated(spark, folders):
        try:
            write_table(kept.unionByName(checked), path, partitions, mode="touched", month_of=month_of)
        except PySparkException as error:
            if _STRAY in str(error):
                raise ValueError(str(error).split(_STRAY, 1)[1].split("\n", 1)[0].join((_STRAY, ""))) from error
            raise
    return rows.get["rows"]


_STRAY = "row outside the replaced range: "


def replace_days(
    spark: SparkSession,
    df: DataFrame,
    path: str,
    days: DataFrame,
    on: Sequence[str] = ("market_id", "date_id"),
    partitions: Sequence[str] = ("market_id",),
    month_of: str = "date_id",
) -> int:
    """Overwrite exactly the days listed in ``days`` (columns ``on``); returns the rows written.

    Like ``replace_date_range``, for days that lie apart: listed days without rows in
    ``df`` are removed, the others of the months touched stay, and a row of a day that
    is not listed is an error.  ``days`` is read several times; store it first.
    """
    days = days.select(*on).distinct()
    if not table_exists(spark, path):
        return write_table(df, path, partitions, month_of=month_of)
    levels = _levels(partitions, month_of)
    touched = with_month(days, month_of).select(*levels).distinct()
    listed = days.withColumn("_listed", F.lit(True))
    stray = F.raise_error(F.concat(F.lit(_STRAY), F.to_json(F.struct(*[F.col(f"d.{c}") for c in on]))))
    marked = df.alias("d").join(listed.alias("l"), _same_names("d", "l", on), "left")
    rows = Observation()
    checked = marked.select(
        *[F.col(f"d.{c}") for c in df.columns if c != month_of],
        F.when(F.col("_listed"), F.col(f"d.{month_of}")).otherwise(stray.cast("int")).alias(month_of),
    ).observe(rows, F.count(F.lit(1)).alias("rows"))
    target = _scan(spark, path, df.schema)
    around = _around(target, touched, levels)
    kept = around.alias("d").join(days.alias("l"), _same_names("d", "l", on), "left_anti").drop(MONTH)
    folders = [_folder(path, r.asDict()) for r in touched.select(*levels).collect()]
    with _vacated(spark, folders):
        write_table(kept.unionByName(checked), path, partitions, mode="touched", month_of=month_of)
    return rows.get["rows"]


def _same_names(left: str, right: str, columns: Sequence[str]) -> Column:
    return reduce(and_, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: Characters that Spark leaves as they are in the name of a partition's folder.
_PLAIN = " !$&()+,-.;<>@_`|~"


def _folder(path: str, values: dict[str, Any]) -> str:
    """The folder of a partition, spelled as Spark spells it."""
    parts = [f"{c}={_NO_VALUE if v is None else quote(str(v), safe=_PLAIN)}" for c, v in values.items()]
    return "/".join([path.rstrip("/"), *parts])


def _parent(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[0]


@contextmanager
def _vacated(spark: SparkSession, folders: Sequence[str]) -> Iterator[None]:
    """After a write of touched partitions, delete those of ``folders`` that it left as they were.

    A folder that got new contents no longer has its old files.  One listing and
    one look a folder; folders that aren't given cost nothing.
    """
    calls = Folders(spark, folders[0]) if folders else None
    old = [(folder, files[0]) for folder in folders if (files := calls.glob(f"{folder}/*.parquet"))]
    yield
    for folder, file in old:
        if calls.exists(file):
            calls.drop(folder)
