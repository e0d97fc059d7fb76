"""Frames fixed in the folder that the cluster shares, so that nothing is computed twice or lost with an executor."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only a local session may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    return folder


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session that holds inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(key, before)
        else:
            spark.conf.unset(key)


def freeing(spark: SparkSession):
    """Inside, the shuffle files of a query go with its end, and not when the driver happens to collect garbage."""
    return setting(spark, FREED, "true")


def batches_of(spark: SparkSession, size: int):
    """Inside, a batch of rows that goes to Python ends with the row that reaches ``size`` bytes, so large rows go one by one."""
    return setting(spark, BATCH, str(size))


def stored(df: DataFrame, name: str, free: bool = False, large_rows: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again; the files go when the session's JVM ends.

    With ``free`` the write is ``freeing`` its shuffle files.  With ``large_rows``, of megabytes each, every row is a row group
    of its own, as a reader holds as much of a group as makes a batch.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with freeing(spark) if free else nullcontext():
        writer = df.write.option("compression", "zstd")
        if large_rows:
            writer = writer.option("parquet.block.row.count.limit", "1")
        writer.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    frame = spark.read.schema(df.schema).parquet(path)
    frame.stored_at = path
    return frame


def dropped(*frames: DataFrame) -> None:
    """Delete the files of frames from ``stored`` now; neither they nor frames read from them can be used any more."""
    for frame in frames:
        place = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame.stored_at)
        place.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
