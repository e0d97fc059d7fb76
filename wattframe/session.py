"""SparkSession set-up shared by jobs, tests and the bench."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Every timestamp in the tables is a UTC instant, so the session zone is pinned:
# otherwise naive values would read back differently from machine to machine.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # Parquet keeps no statistics of the default type of instants, so no filter on one could skip a file.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_spark(app_name: str = "wattframe", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or fetch) a session with the settings the operators rely on.

    ``master`` stays unset on a cluster, where the submit command provides it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return pin_utc(builder.getOrCreate())


def pin_utc(spark: SparkSession) -> SparkSession:
    """Pin the session zone on a session somebody else created."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
