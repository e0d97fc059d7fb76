"""Where landing files lie, reading them, and writing new slices."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import missing_days

# Folders of the landing zone below the base folder.
OPCOM_PRICES = "landing/opcom_pzu/{market_id}"
ENTSOE_GENERATION = "landing/entsoe/{market_id}/generation"
ENTSOE_LOAD = "landing/entsoe/{market_id}/load"
ECB_RATES = "landing/ecb_fx_rates"
BNR_RATES = "landing/bnr_fx_rates"
WEATHER = "landing/weather/{market_id}/{location}"

_DATE = r"(\d{4}-\d{2}-\d{2})"


def file_date(path: Column | str = "path") -> Column:
    """The last ISO date in a path, be it a file name or a ``date=`` folder."""
    path = F.col(path) if isinstance(path, str) else path
    return F.try_to_date(F.element_at(F.regexp_extract_all(path, F.lit(_DATE), F.lit(1)), -1))


def path_market(source: str, path: str = "path") -> Column:
    """Market folder below ``landing/<source>/``."""
    return F.regexp_extract(path, rf"/{source}/(?:market_id=)?([^/]+)/", 1)


def _names_between(start: date | None, end: date | None, suffix: str) -> str:
    """Glob for files named by a date of the months from ``start`` to ``end``."""
    if start is None or end is None:
        return f"*{suffix}"
    first, last = start.year * 12 + start.month - 1, end.year * 12 + end.month - 1
    months = [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(first, last + 1)]
    return f"{{{','.join(months)}}}-*{suffix}"


def read_files(
    spark: SparkSession,
    base: str,
    layout: str,
    start: date | None = None,
    end: date | None = None,
    suffix: str = "",
    named_by_date: bool = True,
    **folders: str,
) -> DataFrame:
    """Whole files as (path, value); no match gives no rows.

    ``folders`` fills the placeholders of ``layout``; one left out matches all.
    Spark lists the folders in parallel, and files of other months are passed
    over by their name; set ``named_by_date`` to False where the day is in a
    folder name instead.
    """
    names = {name: folders.get(name, "*") for name in ("market_id", "location")}
    pattern = f"{base.rstrip('/')}/{layout.format(**names)}"
    root = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root)
    if not found:
        return spark.createDataFrame([], "path string, value string")
    wanted = _names_between(start, end, suffix) if named_by_date else f"*{suffix}"
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", wanted)
        .text(pattern, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    if start is not None:
        files = files.filter(file_date() >= F.lit(start))
    if end is not None:
        files = files.filter(file_date() <= F.lit(end))
    return files


def new_slices(
    slices: DataFrame, present: DataFrame, on: Sequence[str], refetch: bool = False
) -> DataFrame:
    """Slices that are not in the landing zone yet, or all of them with ``refetch``."""
    return slices if refetch else missing_days(slices, present, on)


def write_slices(
    slices: DataFrame, path: str, on: Sequence[str], text: str = "value", refetch: bool = False
) -> None:
    """Write one text file per slice under ``column=value`` folders.

    Slices already present are skipped; ``refetch`` overwrites exactly the
    folders of the given slices.  ``on`` must identify a slice.
    """
    spark = slices.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    if exists and not refetch:
        schema = ", ".join(
            f"`{c}` {slices.schema[c].dataType.simpleString()}" for c in on
        )
        present = spark.read.schema(f"value string, {schema}").text(path).select(*on)
        slices = new_slices(slices, present, on)
    writer = slices.select(*on, F.col(text).alias("value")).repartition(*on).write
    writer = writer.partitionBy(*on).option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite" if refetch else "append").text(path)
