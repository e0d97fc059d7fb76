"""A history in buckets: same outcome as without, and no exchange of it."""

import re
from collections import Counter
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wattframe.operators.bucketed import append_to_buckets, new_in_buckets, read_buckets
from wattframe.operators.changes import new_observations
from wattframe.operators.store import read_table

SCHEMA = "k string, d date, n int, v double, w string, ingested_at timestamp"
LAYOUT = {"keys": ("k", "d", "n"), "buckets": 4, "month_of": "d"}
VALUES = ("v", "w")


def rows(spark, run, days=90):
    """Every run repeats most rows, changes some values, makes some NULL, and returns some to what they were."""
    first = date(2026, 1, 1)
    return spark.createDataFrame(
        [
            (k, first + timedelta(days=i), n, None if (i + n) % 7 == run % 3 else float(i % 5 + (run % 2) * (i % 4 == 0)),
             None if n else "w", datetime(2026, 6, 1 + run))
            for k in ("a", "b") for i in range(days) for n in range(3)
        ],
        SCHEMA,
    )


def known(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("compare", ["any", "latest"])
def test_appends_equal_plain_change_detection(spark, base, compare):
    path = f"{base}/bronze/t"
    for run in range(4):
        batch = rows(spark, run, 40 + 25 * run)
        before = read_table(spark, path, schema=batch.schema) if run else batch.limit(0)
        want = known(new_observations(batch, before, LAYOUT["keys"], VALUES, compare))
        assert append_to_buckets(spark, batch, path, values=VALUES, compare=compare, **LAYOUT) == want.total()
        own = read_table(spark, path, schema=batch.schema).filter(F.col("ingested_at") == F.lit(datetime(2026, 6, 1 + run)))
        assert known(own) == want
    assert append_to_buckets(spark, batch, path, values=VALUES, compare=compare, **LAYOUT) == 0
    assert append_to_buckets(spark, batch.limit(0), path, values=VALUES, compare=compare, **LAYOUT) == 0


@pytest.mark.parametrize("compare", ["any", "latest"])
def test_only_the_batch_is_exchanged(spark, base, compare):
    path = f"{base}/bronze/t"
    for run in range(2):
        append_to_buckets(spark, rows(spark, run), path, values=VALUES, **LAYOUT)
    batch = rows(spark, 2, 10)
    history = read_buckets(spark, path, batch.schema, span=(date(2026, 1, 1), date(2026, 1, 10)), **LAYOUT)
    fresh = new_in_buckets(batch, history, LAYOUT["keys"], VALUES, compare)
    fresh.collect()
    plan = fresh._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 1
    lines = plan.splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "Bucketed: true" in x)
    depth = [len(re.match(r"[ :+-]*", x)[0]) for x in lines]
    above, level = [], depth[scan]
    for i in range(scan - 1, -1, -1):
        if depth[i] < level:
            above.append(lines[i])
            level = depth[i]
    assert any("SortMergeJoin" in x for x in above) and not any("Exchange" in x for x in above)
    assert "PartitionFilters" in lines[scan] and "month_id" in lines[scan] and "SelectedBucketsCount: 4 out of 4" in lines[scan]


def test_files_are_one_a_bucket_and_month(spark, base):
    path = f"{base}/bronze/t"
    append_to_buckets(spark, rows(spark, 0), path, values=VALUES, **LAYOUT)
    months = sorted(Path(path).glob("month_id=*"))
    assert [m.name for m in months] == ["month_id=202601", "month_id=202602", "month_id=202603"]
    for month in months:
        ids = [re.search(r"_(\d{5})\.c000", f.name)[1] for f in month.glob("*.parquet")]
        assert len(ids) == len(set(ids)) <= 4


def test_another_number_of_buckets_is_refused(spark, base):
    path = f"{base}/bronze/t"
    append_to_buckets(spark, rows(spark, 0), path, values=VALUES, **LAYOUT)
    with pytest.raises(ValueError):
        new_in_buckets(rows(spark, 0), rows(spark, 0), LAYOUT["keys"], VALUES, "never")
    fewer = {**LAYOUT, "buckets": 2}  # Spark would leave the files of the other buckets out without a word
    with pytest.raises(ValueError, match="2 buckets"):
        read_buckets(spark, path, rows(spark, 0).schema, **fewer)
    with pytest.raises(ValueError, match="2 buckets"):
        append_to_buckets(spark, rows(spark, 0), path, values=VALUES, **fewer)
