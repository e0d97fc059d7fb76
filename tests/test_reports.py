"""Reports that are merged from run to run, against those that read everything."""

import random
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from wattframe.operators import manifest, quality, sketches
from wattframe.operators.store import read_table


def known(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def tried(spark):
    """Attempts around the limits of a bitmap (days 0 and 32,768 since 1970) and elsewhere."""
    r = random.Random(2)
    days = [date(1970, 1, 1) + timedelta(days=d) for d in (-40000, -32769, -32768, -9, -8, -1, 0, 1, 7, 8, 9, 20000, 32767, 32768, 32769, 65536, 65537)]
    rows = [(r.choice("ab"), r.choice(days), r.choice(["fetched", "skipped", "failed", "odd"])) for _ in range(60)] + [("a", None, "fetched")]
    return spark.createDataFrame(rows, "source string, date date, status string"), days


def test_manifest_equals_reports_over_all_days(spark, base, tried):
    attempts, days = tried
    expected = spark.createDataFrame([(s, d) for s in "abc" for d in days], "source string, date date")
    path, whole = f"{base}/control/days", attempts.withColumn("n", F.monotonically_increasing_id())
    changed = [manifest.record_days(spark, path, whole.filter(F.col("n") % 3 == run), ["source", "status"]) for run in (0, 1, 2, 2)]
    assert all(changed[:3]) and changed[3] == 0
    held = read_table(spark, path)
    on = ["source", "date"]
    assert known(manifest.coverage_of_manifest(expected, held, ["source"])) == known(quality.coverage(expected, attempts, on))
    one = manifest.merged_bitmaps(held, ["source"])
    assert known(manifest.missing_in_manifest(expected, one, ["source"])) == known(quality.missing_days(expected, attempts, on))
    counts = {r.source: r.days for r in manifest.days_held(one, ["source"]).collect()}
    assert counts == {r.source: r.n for r in attempts.filter("date IS NOT NULL").groupBy("source").agg(F.count_distinct("date").alias("n")).collect()}


def test_manifest_of_nothing(spark, base):
    expected = spark.createDataFrame([("a", date(2026, 1, 1))], "source string, date date")
    none = manifest.day_bitmaps(expected.limit(0), ["source"])
    assert known(manifest.missing_in_manifest(expected, none, ["source"])) == known(expected)


@pytest.mark.parametrize("k", [200, 1000])
def test_merged_quantiles_are_within_the_bound(spark, k):
    r = random.Random(k)
    rows = [(("a", "b")[i % 2], i % 50, r.gauss(0, 1) if i % 3 else float(i % 7), None) for i in range(20_000)]
    df = spark.createDataFrame(rows, "g string, day int, v double, empty double").repartition(6)
    daily = sketches.sketched(df, ["g", "day"], ["v", "empty"], k)
    merged = spark.createDataFrame(sketches.merged_sketches(daily, ["g"], k).collect(), sketches.merged_sketches(daily, ["g"], k).schema)
    shares = {f"p{i}": i / 20 for i in range(1, 20)}
    checked = sketches.within_error(df, sketches.approximate_profile(merged, shares), ["g"], ["v", "empty"], shares, k).collect()
    full = [row for row in checked if row["column"] == "v"]
    assert len(full) == 2 and all(row[f"{name}_within"] for row in full for name in shares)
    assert [(row.rows, row.nulls, row.low) for row in full] == [(10_000, 0, min(x[2] for x in rows if x[0] == row.g)) for row in full]
    empty = [row for row in checked if row["column"] == "empty"]
    assert all(row.nulls == row.rows == 10_000 and row.low is None and row.p5_within is None for row in empty)
    assert sketches.rank_error(1000) < 0.008 < sketches.rank_error(200)
