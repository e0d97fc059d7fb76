"""One key holds most rows: results stay whole and no task gets the key as a whole."""

import re

from pyspark.sql import functions as F

from wattframe.operators.fill import asof_join
from wattframe.operators.latest import latest_per_key
from wattframe.operators import usage
from wattframe.operators.usage import trailing_requests

ROWS = 200_000


def hot(spark):
    """Two of three rows belong to key 0; instants spread over some twelve days."""
    return spark.range(ROWS, numPartitions=8).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).alias("key_id"),
        F.timestamp_seconds(F.col("id") * 5).alias("occurred_at"), "id",
    )


def largest_share(df, *cells):
    return df.groupBy(*cells).count().agg(F.max("count")).first()[0] / ROWS


def test_latest_sends_one_row_per_key_and_task(spark):
    newest = latest_per_key(hot(spark), ["key_id"], "occurred_at")
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")
    assert newest.filter("key_id = 0").first().id == ROWS - 1
    assert newest.count() == hot(spark).select("key_id").distinct().count()


def test_trailing_count_of_a_hot_key(spark):
    counted = trailing_requests(hot(spark), 60, 600)
    chunk = F.floor(F.unix_seconds("occurred_at") / 600)
    assert largest_share(counted, "key_id", chunk) < 0.001
    assert counted.count() == ROWS
    # A request every 5 seconds, two of three by key 0: twelve instants in 60 seconds.
    steady = counted.filter("key_id = 0 AND id > 100").agg(F.min("recent"), F.max("recent")).first()
    assert tuple(steady) == (8, 8)


def test_admission_of_a_hot_key(spark, monkeypatch):
    """Key 0 has an excess for a minute every hour: only the runs around it are folded, each by itself."""
    events = spark.range(ROWS, numPartitions=8).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).alias("key_id"),
        F.timestamp_seconds(F.when(F.col("id") % 720 < 60, F.col("id") * 5 - F.col("id") % 720 * 4).otherwise(F.col("id") * 5)).alias("occurred_at"),
        "id",
    )
    limits = spark.range(1).select(F.col("id").alias("key_id"), F.lit(20).alias("limit"))
    seen = []
    real = usage.forward_fill

    def watched(df, *args, **kwargs):
        seen.append(real(df, *args, **kwargs))
        return seen[-1]

    monkeypatch.setattr(usage, "forward_fill", watched)
    answered = usage.admission(events, limits, ["id"])
    assert answered.count() == ROWS
    runs = seen[0].groupBy("key_id", "_run").count()
    assert runs.count() >= ROWS // 720 and runs.agg(F.max("count")).first()[0] < 0.001 * ROWS
    refused = answered.filter("NOT allowed")
    assert refused.filter("key_id <> 0").isEmpty()
    # 40 of 60 seconds have a request by key 0; the limit lets 20 in, and the next ones 60 seconds after each of these
    assert refused.filter("id < 720").count() == 20
    assert answered.filter("allowed AND remaining < 0").isEmpty()


def test_admission_of_many_requests_in_a_span(spark, monkeypatch):
    """No frame slides, as Spark adds it up anew at each row: the work would be the square of the requests in a span."""
    plans = []
    real = usage.stored

    def watched(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().analyzed().toString())
        return real(df, *args, **kwargs)

    monkeypatch.setattr(usage, "stored", watched)
    events = spark.range(3000).select((F.col("id") % 2).alias("key_id"), F.timestamp_micros(F.col("id") * 1_000_000).alias("occurred_at"), "id")
    limits = spark.range(1).select(F.col("id").alias("key_id"), F.lit(2).alias("limit"))
    answered = usage.admission(events, limits, ["id"], 600)
    plans.append(answered._jdf.queryExecution().analyzed().toString())
    frames = re.findall(r"specifiedwindowframe\(RangeFrame, ([^,]*),", " ".join(plans))
    assert len(frames) > 4 and set(frames) == {"unboundedpreceding$()"}
    allowed = answered.filter("allowed AND key_id = 0").select(F.unix_seconds("occurred_at").alias("s")).collect()
    assert sorted(r.s for r in allowed) == [600 * k + s for k in range(5) for s in (0, 2)]


def test_asof_of_a_hot_key(spark):
    left = hot(spark)
    right = spark.range(0, ROWS * 5, 3600).select(
        F.lit(0).cast("long").alias("key_id"), F.timestamp_seconds("id").alias("occurred_at"),
        F.col("id").alias("at"),
    )
    joined = asof_join(left, right, ["key_id"], "occurred_at", ["at"], chunk="day", salts=4)
    assert joined.count() == ROWS
    wrong = joined.filter("key_id = 0").filter(
        F.col("at") != F.floor(F.unix_seconds("occurred_at") / 3600) * 3600
    )
    assert wrong.isEmpty()
    assert joined.filter("key_id <> 0 AND at IS NOT NULL").isEmpty()
