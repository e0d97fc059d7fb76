"""State across batches and restarts, against plain change detection."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wattframe.streaming.ingest import changed_observations, to_folder

SCHEMA = "k string, m long, ts timestamp, n int, v double, w string, big long"
T0 = datetime(2026, 1, 1)


def batch(number, count=300):
    r = random.Random(number)
    return [
        (r.choice(["a", "b", None]), r.randint(0, 2), T0 + timedelta(hours=40 * number, minutes=r.randint(0, 2000), microseconds=r.randint(0, 3)),
         i, r.choice([1.0, 2.0, None, float("nan")]), r.choice(["x", None, 'q"\n']), 2**60 + i)
        for i in range(count)
    ]


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def text(rows):
    return Counter(str(tuple(r)) for r in rows)


def test_changes_across_batches_and_a_restart_equal_the_whole(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rows = []
    for number in range(3):
        rows += batch(number)
        add(spark, source, batch(number))
        if number == 1:
            continue  # two batches at once
        changes = changed_observations(stream(spark, source), ["k", "m"], ["v", "w"], "ts", ["n"], timedelta(days=30))
        to_folder(changes, out, checkpoint).awaitTermination()
    to_folder(changed_observations(stream(spark, source), ["k", "m"], ["v", "w"], "ts", ["n"], timedelta(days=30)), out, checkpoint).awaitTermination()
    whole = spark.createDataFrame(rows, SCHEMA)
    walk = Window.partitionBy("k", "m").orderBy("ts", "n")
    value = F.to_json(F.struct("v", "w"), {"ignoreNullFields": "false"})
    want = whole.withColumn("_before", F.lag(value).over(walk)).filter(~F.col("_before").eqNullSafe(value)).drop("_before")
    got = spark.read.schema(SCHEMA).parquet(out)
    assert text(got.collect()) == text(want.collect()) and 0 < got.count() < len(rows)


def test_state_goes_with_the_watermark(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    row = lambda k, hour, v: (k, 1, T0 + timedelta(hours=hour), 1, v, "x", 1)
    batches = ([row("a", 0, 1.0), row("b", 0, 1.0)], [row("b", 90, 1.0)], [row("b", 91, 1.0)], [row("a", 92, 1.0), row("b", 92, 2.0)])
    for rows in batches:
        add(spark, source, rows)
        changes = changed_observations(stream(spark, source), ["k"], ["v"], "ts", lateness=timedelta(hours=24))
        to_folder(changes, out, checkpoint).awaitTermination()
    got = [(r.k, (r.ts - T0) // timedelta(hours=1), r.v) for r in spark.read.schema(SCHEMA).parquet(out).collect()]
    # a's state went when the watermark reached 24 hours past its last reading, b's was kept by the repeats
    assert sorted(got) == [("a", 0, 1.0), ("a", 92, 1.0), ("b", 0, 1.0), ("b", 92, 2.0)]


def test_tuples_seen_before_are_dropped(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rows = []
    for number in range(2):
        rows += batch(number)
        add(spark, source, batch(number))
        fresh = changed_observations(stream(spark, source), ["k", "m"], ["v", "w"], "ts", lateness=timedelta(days=30), compare="any")
        to_folder(fresh, out, checkpoint).awaitTermination()
    columns = ["k", "m", "v", "w"]
    got = spark.read.schema(SCHEMA).parquet(out).select(*columns).collect()
    assert text(got) == text(spark.createDataFrame(rows, SCHEMA).select(*columns).distinct().collect())
    with pytest.raises(ValueError):
        changed_observations(stream(spark, source), ["k"], ["v"], "ts", compare="never")
