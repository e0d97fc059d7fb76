from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wattframe.operators.changes import merged_rows, new_observations, replaced_range
from wattframe.operators.latest import latest_per_key
from wattframe.operators import store
from wattframe.operators.store import (
    MONTH,
    TableNotFound,
    append_new_observations,
    merge_upsert,
    month_of_value,
    read_table,
    replace_date_range,
    with_month,
)

OBS = "k string, d date, v double, ingested_at timestamp"
KEYED = "market_id string, date_id int, n int, v double"


def obs(spark, *rows):
    return spark.createDataFrame(
        [(k, date.fromisoformat(d), v, datetime(2026, 1, 1, h)) for k, d, v, h in rows], OBS
    )


def keyed(spark, *rows):
    return spark.createDataFrame(list(rows), KEYED)


def rows_of(spark, path):
    rows = read_table(spark, path, schema=KEYED)
    return {tuple(r) for r in rows.select("market_id", "date_id", "n", "v").collect()}


def append(spark, df, path, **options):
    append_new_observations(spark, df, path, ["k", "d"], ["v"], ["k"], **options)


@pytest.mark.parametrize("prune", [None, "d"])
def test_append_skips_known_and_keeps_revisions(spark, base, prune):
    path = f"{base}/bronze/t"
    first = obs(spark, ("a", "2026-01-01", 1.0, 0), ("a", "2026-01-02", None, 0))
    append(spark, first, path, prune=prune)
    append(spark, first.withColumn("ingested_at", F.lit(datetime(2026, 1, 2))), path, prune=prune)
    assert read_table(spark, path).count() == 2
    append(spark, obs(spark, ("a", "2026-01-01", 2.0, 3), ("b", "2026-01-05", 1.0, 3)), path, prune=prune)
    assert read_table(spark, path).count() == 4
    current = latest_per_key(read_table(spark, path), ["k", "d"])
    assert {(r.k, r.d.day): r.v for r in current.collect()} == {
        ("a", 1): 2.0, ("a", 2): None, ("b", 5): 1.0
    }


def test_value_that_returns_is_recorded_only_against_the_latest(spark):
    history = obs(spark, ("a", "2026-01-01", 1.0, 0), ("a", "2026-01-01", 2.0, 1))
    back = obs(spark, ("a", "2026-01-01", 1.0, 2))
    assert new_observations(back, history, ["k", "d"], ["v"]).isEmpty()
    assert new_observations(back, history, ["k", "d"], ["v"], compare="latest").count() == 1
    with pytest.raises(ValueError):
        new_observations(back, history, ["k", "d"], ["v"], compare="never")


def test_duplicates_inside_a_batch_are_kept(spark, base):
    path = f"{base}/bronze/t"
    append(spark, obs(spark, ("a", "2026-01-01", 1.0, 0)), path)
    append(spark, obs(spark, ("a", "2026-01-01", 2.0, 1), ("a", "2026-01-01", 2.0, 1)), path)
    assert read_table(spark, path).count() == 3


def test_latest_per_key_tiebreak(spark):
    df = obs(spark, ("a", "2026-01-01", 1.0, 0), ("a", "2026-01-01", 5.0, 0), ("a", "2026-01-01", None, 0))
    assert latest_per_key(df, ["k"], tiebreak=["v"]).collect()[0].v == 5.0


@pytest.mark.parametrize("parts", [(), ("market_id", "date_id")])
def test_upsert(spark, base, parts):
    path = f"{base}/silver/t"
    upsert = lambda df: merge_upsert(spark, df, path, ["market_id", "n"], parts)
    upsert(keyed(spark, ("RO", 20260101, 1, 1.0), ("RO", 20260101, 2, 2.0), ("DE", 20260101, 1, 9.0)))
    batch = keyed(spark, ("RO", 20260101, 1, 5.0), ("RO", 20260102, 3, 3.0))
    upsert(batch)
    assert rows_of(spark, path) == {
        ("DE", 20260101, 1, 9.0), ("RO", 20260101, 1, 5.0),
        ("RO", 20260101, 2, 2.0), ("RO", 20260102, 3, 3.0),
    }
    upsert(batch)
    assert read_table(spark, path, schema=KEYED).count() == 4
    assert not list(Path(base).glob("silver/_staging/*"))


def test_upsert_moves_a_key_and_drops_the_emptied_partition(spark, base):
    path, parts = f"{base}/silver/t", ["market_id", "date_id"]
    merge_upsert(spark, keyed(spark, ("RO", 20260101, 1, 1.0), ("RO", 20260103, 7, 7.0)), path, ["n"], parts)
    merge_upsert(spark, keyed(spark, ("RO", 20260102, 1, 2.0)), path, ["n"], parts)
    rows = {(r.date_id, r.n, r.v) for r in read_table(spark, path, schema=KEYED).collect()}
    assert rows == {(20260102, 1, 2.0), (20260103, 7, 7.0)}
    assert not (Path(path) / "market_id=RO" / "date_id=20260101").exists()


def test_upsert_leaves_other_partitions_alone(spark, base):
    path, parts = f"{base}/silver/t", ["market_id", "date_id"]
    merge_upsert(spark, keyed(spark, ("RO", 1, 1, 1.0), ("RO", 2, 2, 2.0)), path, ["n"], parts)
    before = sorted((Path(path) / "market_id=RO" / "date_id=2").iterdir())
    merge_upsert(spark, keyed(spark, ("RO", 1, 1, 4.0)), path, ["n"], parts, key_fixes_partition=True)
    assert sorted((Path(path) / "market_id=RO" / "date_id=2").iterdir()) == before


def test_upsert_rejects_a_key_given_twice_and_keeps_null_keys(spark, base):
    path = f"{base}/silver/t"
    merge_upsert(spark, keyed(spark, ("RO", 1, None, 1.0)), path, ["n"])
    with pytest.raises(ValueError, match="share a key"):
        merge_upsert(spark, keyed(spark, ("RO", 1, 1, 1.0), ("RO", 1, 1, 2.0)), path, ["n"])
    merge_upsert(spark, keyed(spark, ("RO", 1, None, 2.0)), path, ["n"])
    assert read_table(spark, path).count() == 2


def test_upsert_with_zone_names_as_partitions(spark, base):
    path = f"{base}/silver/t"
    rows = lambda v: spark.createDataFrame([("Europe/Bucharest", 1, v)], "timezone string, n int, v double")
    merge_upsert(spark, rows(1.0), path, ["timezone", "n"], ["timezone"])
    merge_upsert(spark, rows(2.0), path, ["timezone", "n"], ["timezone"])
    assert [r.v for r in read_table(spark, path).collect()] == [2.0]


def test_replace_range(spark, base):
    path = f"{base}/gold/t"
    replace = lambda df, lo, hi: replace_date_range(spark, df, path, "RO", lo, hi)
    replace(keyed(spark, *[("RO", d, 1, 1.0) for d in (1, 2, 3, 4)], ("DE", 2, 1, 1.0)), 2, 3)
    assert read_table(spark, path).count() == 5  # first write takes the frame as it is
    replace(keyed(spark, ("RO", 2, 1, 8.0)), 2, 3)
    rows = {(r.market_id, r.date_id): r.v for r in read_table(spark, path).collect()}
    assert rows == {("RO", 1): 1.0, ("RO", 2): 8.0, ("RO", 4): 1.0, ("DE", 2): 1.0}
    with pytest.raises(ValueError, match="outside"):
        replace(keyed(spark, ("RO", 9, 1, 8.0)), 2, 3)
    replace(keyed(spark, ("RO", 2, 1, 8.0)).limit(0), 1, 4)
    assert [r.market_id for r in read_table(spark, path).collect()] == ["DE"]
    both = keyed(spark, ("RO", 2, 1, 3.0), ("DE", 2, 1, 4.0))
    replace_date_range(spark, both, path, ["RO", "DE"], 1, 9)
    assert {r.market_id: r.v for r in read_table(spark, path).collect()} == {"RO": 3.0, "DE": 4.0}


def test_a_table_without_rows(spark, base):
    path = f"{base}/bronze/t"
    append(spark, obs(spark, ("a", "2026-01-01", 1.0, 0)).limit(0), path)
    with pytest.raises(TableNotFound):
        read_table(spark, path)
    assert read_table(spark, path, schema=OBS).isEmpty()
    append(spark, obs(spark, ("a", "2026-01-01", 1.0, 0)), path, prune="d")
    assert read_table(spark, path).count() == 1


def test_frame_algebra_matches(spark):
    target = keyed(spark, ("RO", 1, 1, 1.0), ("RO", 2, 2, 2.0), ("DE", 1, 3, 3.0), (None, 1, 4, 4.0))
    merged = merged_rows(target, keyed(spark, ("RO", 5, 1, 9.0)), ["n"])
    assert {(r.n, r.v) for r in merged.collect()} == {(1, 9.0), (2, 2.0), (3, 3.0), (4, 4.0)}
    replaced = replaced_range(target, keyed(spark, ("RO", 1, 8, 8.0)), "RO", 1, 2)
    assert {r.n for r in replaced.collect()} == {8, 3, 4}


def test_read_filters(spark, base):
    path = f"{base}/gold/t"
    with pytest.raises(TableNotFound):
        read_table(spark, path)
    replace_date_range(spark, keyed(spark, *[("RO", d, d, 1.0) for d in range(5)]), path, "RO", 0, 9)
    read = lambda *f: sorted(r.date_id for r in read_table(spark, path, f).collect())
    assert read(("market_id", "=", "RO"), ("date_id", ">=", 1), ("date_id", "<", 3)) == [1, 2]
    assert read(("date_id", "in", [0, 4])) == [0, 4] and read(("date_id", "not in", [0])) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        read(("date_id", "~", 1))
    plan = read_table(spark, path, [("date_id", ">=", 3)], month_of="date_id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month_id" in plan


def test_months_of_dates_instants_and_numbers(spark):
    rows = spark.createDataFrame(
        [(date(2026, 7, 31), datetime(2026, 8, 1, 0, 30), 20260930, None)], "d date, t timestamp, n int, e date"
    )
    assert [with_month(rows, c).first()[MONTH] for c in "dtne"] == [202607, 202608, 202609, None]
    assert [month_of_value(v) for v in rows.first()[:3]] == [202607, 202608, 202609]


def days_of(spark, path):
    rows = read_table(spark, path, schema=KEYED)
    return {(r.market_id, r.date_id, r.n): r.v for r in rows.collect()}


def test_range_keeps_the_other_days_of_a_month(spark, base):
    path = f"{base}/gold/t"
    days = [20260130, 20260131, 20260201, 20260202, 20260301]
    first = [(m, d, 1, 1.0) for m in ("RO", "DE") for d in days]
    replace_date_range(spark, keyed(spark, *first), path, ["RO", "DE"], 0, 99999999)
    assert sorted(p.name for p in Path(path, "market_id=RO").iterdir()) == ["month_id=202601", "month_id=202602", "month_id=202603"]
    kept = sorted(Path(path, "market_id=DE").rglob("*.parquet"))
    new = keyed(spark, ("RO", 20260131, 1, 5.0), ("RO", 20260131, 2, 6.0))
    assert replace_date_range(spark, new, path, "RO", 20260131, 20260202) == 2
    want = {(m, d, n): v for m, d, n, v in first if m == "DE" or d in (20260130, 20260301)}
    assert days_of(spark, path) == {**want, ("RO", 20260131, 1): 5.0, ("RO", 20260131, 2): 6.0}
    assert not Path(path, "market_id=RO", "month_id=202602").exists()  # no day of it is left
    assert sorted(Path(path, "market_id=DE").rglob("*.parquet")) == kept
    with pytest.raises(ValueError, match="outside"):
        replace_date_range(spark, keyed(spark, ("RO", 20260301, 1, 9.0)), path, "RO", 20260131, 20260202)
    with pytest.raises(ValueError, match="outside"):
        replace_date_range(spark, keyed(spark, (None, 20260201, 1, 9.0)), path, "RO", 20260131, 20260202)
    assert days_of(spark, path) == {**want, ("RO", 20260131, 1): 5.0, ("RO", 20260131, 2): 6.0}


def test_upsert_in_months_moves_keys_and_keeps_null_partitions(spark, base):
    path, options = f"{base}/silver/t", {"partitions": ["market_id"], "month_of": "date_id"}
    upsert = lambda *rows: merge_upsert(spark, keyed(spark, *rows), path, ["n"], **options)
    upsert(("A/B c=1%", 20260101, 1, 1.0), ("A/B c=1%", 20260102, 2, 2.0), (None, 20260101, 3, 3.0), ("RO", None, 4, 4.0))
    assert upsert(("RO", 20260301, 1, 7.0)) == 1
    assert days_of(spark, path) == {
        ("A/B c=1%", 20260102, 2): 2.0, (None, 20260101, 3): 3.0, ("RO", None, 4): 4.0, ("RO", 20260301, 1): 7.0
    }
    upsert(("RO", 20260302, 2, 8.0), (None, 20260103, 5, 5.0))  # leaves the first folder without rows
    assert days_of(spark, path) == {
        ("RO", 20260302, 2): 8.0, (None, 20260101, 3): 3.0, (None, 20260103, 5): 5.0, ("RO", None, 4): 4.0, ("RO", 20260301, 1): 7.0
    }
    assert len(list(Path(path).glob("market_id=*/month_id=*"))) == 3


def test_calls_do_not_grow_with_the_table(spark, base, monkeypatch):
    """2,000 partitions, of which a run touches two or three."""
    path = f"{base}/gold/t"
    all_days = spark.range(2000).select(
        F.concat(F.lit("M"), (F.col("id") % 8).cast("string")).alias("market_id"),
        ((2000 + F.floor(F.col("id") / 96)) * 10000 + (F.floor(F.col("id") / 8) % 12 + 1) * 100 + 5).cast("int").alias("date_id"),
        F.lit(1).alias("n"), F.lit(1.0).alias("v"),
    )
    store.write_table(all_days, path, ["market_id"], month_of="date_id")
    assert len(list(Path(path).glob("*/*"))) == 2000
    calls = []
    for name in ("exists", "drop", "glob"):
        real = getattr(store.Folders, name)
        monkeypatch.setattr(store.Folders, name, lambda self, p, real=real, name=name: calls.append((name, p)) or real(self, p))
    files = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    replace_date_range(spark, keyed(spark, ("M1", 20050106, 1, 2.0)), path, "M1", 20050101, 20050331)
    merge_upsert(spark, keyed(spark, ("M2", 20050105, 1, 3.0), ("M3", 20110405, 1, 3.0)), path, ["market_id", "date_id"],
                 ["market_id"], key_fixes_partition=True, month_of="date_id")
    assert len(calls) <= 16, calls
    now = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    assert len(set(files) - set(now)) == 5 and len(set(now) - set(files)) == 3
    assert days_of(spark, path)["M3", 20110405, 1] == 3.0
