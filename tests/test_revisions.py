"""Outcomes that must not depend on row order, on where a range begins, or on a zone's offset."""

import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattframe.functions import text
from wattframe.operators.changes import new_observations
from wattframe.operators.store import merge_upsert, read_table
from wattframe.plans import jobs, reports, silver
from wattframe.registry import Market
from wattframe.schemas import ENTSOE_LOAD, OPCOM_PRICES

RUN = datetime(2026, 6, 1)
INDIA = {"IN": Market("10YIN-TEST-----X", "Asia/Kolkata", "INR", "India", fx_source="ECB")}


def test_ties_of_one_run_are_settled_by_value(spark):
    rows = [("RO", date(2026, 6, 1), 1, price, 1.0, 1.0, float(k), RUN, url) for k, (price, url) in enumerate(
        [(5.0, "a"), (7.0, "a"), (7.0, "b"), (None, "z")]
    )]
    rows = [(*r[:6], 2.0, *r[7:]) for r in rows]
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        (kept,) = silver.current(spark.createDataFrame(rows, OPCOM_PRICES.schema).repartition(3), OPCOM_PRICES).collect()
        assert (kept.price_lei_mwh, kept.source_url) == (7.0, "b")


def test_latest_mode_sees_the_greatest_of_equal_times(spark):
    schema = "k int, v double, ingested_at timestamp"
    history = spark.createDataFrame([(1, 1.0, RUN), (1, 2.0, RUN)], schema)
    later = RUN + timedelta(days=1)
    incoming = spark.createDataFrame([(1, 1.0, later), (1, 2.0, later)], schema)
    assert [r.v for r in new_observations(incoming, history, ["k"], ["v"], "latest").collect()] == [1.0]
    assert new_observations(incoming, history, ["k"], ["v"]).collect() == []


def test_half_hour_zone_is_the_same_day_by_day_and_in_one_run(spark):
    begin = datetime(2026, 6, 1, 12)
    rows = [("IN", begin + timedelta(minutes=15 * i), float(i), RUN) for i in range(4 * 72)]
    load = spark.createDataFrame(rows, ENTSOE_LOAD.schema)
    first, last = date(2026, 6, 2), date(2026, 6, 3)
    whole = silver.fact_load(load, INDIA, first, last).collect()
    parts = [r for day in (first, last) for r in silver.fact_load(load, INDIA, day, day).collect()]
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts)) and len(whole) == 48
    assert {r.hour_start_utc.minute for r in whole} == {30}
    assert len({r.hour_start_utc for r in whole}) == 48


def test_the_first_write_of_a_table_refuses_two_rows_of_a_key(spark, base):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, v double")
    with pytest.raises(ValueError):
        merge_upsert(spark, df, f"{base}/t", ["k"])
    assert merge_upsert(spark, df.limit(1), f"{base}/t", ["k"]) == 1
    assert read_table(spark, f"{base}/t").count() == 1


def test_whole_numbers(spark):
    values = [1.9, -1.9, math.nan, None, 1e30, math.inf, 0.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = [r.y for r in df.select("i", text.integer_or_null("x").alias("y")).orderBy("i").collect()]
    assert got == [1, -1, None, None, None, None, 0]


def test_weather_of_a_market_and_some_days(spark):
    facts = spark.createDataFrame(
        [(20260600 + d, 0, datetime(2026, 6, d), place, "REALIZED", 1.0, 2.0, 3.0) for d in (1, 2, 3) for place in (1, 2)],
        "date_id int, time_id int, hour_start_utc timestamp, location_id int, data_type string, temperature_c double, "
        "wind_speed_ms double, solar_irradiance_wm2 double",
    )
    places = spark.createDataFrame(
        [(1, "a", "RO", 1.0, 1.0, 1.0), (2, "b", "DE", 1.0, 1.0, 1.0)],
        "location_id int, location_name string, market_id string, wind_weight double, solar_weight double, demand_weight double",
    )
    got = reports.weather_hourly(facts, places, "RO", date(2026, 6, 2), date(2026, 6, 3)).collect()
    assert sorted((r.market_id, r.date_id) for r in got) == [("RO", 20260602), ("RO", 20260603)]


def test_one_run_ingests_all_markets(spark, tmp_path):
    head = '"Zona de tranzactionare","Interval","Pret","Volum","Cumparare","Vanzare"'
    for market, slots in (("RO", 96), ("IN", 24)):
        folder = tmp_path / "landing" / "opcom_pzu" / market
        folder.mkdir(parents=True)
        lines = [head, *(f'"x","{i}","{i}.5","1","1","1"' for i in range(1, slots + 1))]
        (folder / "2026-06-02.csv").write_text("\n".join(lines))
    markets = {**INDIA, "RO": Market("10YRO-TEST-----X", "Europe/Bucharest", "RON", "Romania")}
    day = date(2026, 6, 2)
    done = jobs.ingest_prices(
        spark, str(tmp_path), str(tmp_path / "tables"), None, day, day + timedelta(days=1), markets=markets
    )
    assert done.rows == 96
    assert [(r.market_id, r.reason) for r in done.rejected.collect()] == [("IN", "hourly")]
    status = {(r.market_id, r.date.day): r.status for r in done.coverage.collect()}
    assert status == {("RO", 2): "fetched", ("RO", 3): "missing", ("IN", 2): "failed", ("IN", 3): "missing"}
    again = jobs.ingest_prices(spark, str(tmp_path), str(tmp_path / "tables"), None, day, day, markets=markets)
    assert again.rows == 0
    dropped = silver.dropped_prices(
        read_table(spark, OPCOM_PRICES.path(str(tmp_path / "tables"))).withColumn("market_id", F.lit("XX")), markets, day, day
    )
    assert [(r.reason, r.key, r.dropped_rows) for r in dropped.collect()] == [("unknown market", "XX", 96)]


def test_one_market_is_a_filter_and_no_join(spark):
    load = spark.createDataFrame(
        [(m, datetime(2026, 6, 1, 3), 4.0, datetime(2026, 6, 2)) for m in ("IN", "RO")],
        "market_id string, timestamp_utc timestamp, actual_load_mw double, ingested_at timestamp",
    )
    renamed = load.withColumn("market_id", F.lit("IN"))  # a literal, which a join would lose as its key
    for frame, rows in ((load, 1), (renamed, 1), (load.withColumn("market_id", F.lit("XX")), 0)):
        known = silver.with_market(frame.limit(1) if frame is not load else frame, INDIA, "timezone", "currency")
        assert "Join" not in known._jdf.queryExecution().executedPlan().toString()
        assert [(r.timezone, r.currency) for r in known.collect()] == [("Asia/Kolkata", "INR")] * rows
