"""A refresh of the touched days equals a full build, and touches nothing else."""

import random
from collections import Counter
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wattframe import schemas
from wattframe.operators.store import read_table
from wattframe.plans import bronze, jobs
from wattframe.plans.refresh import _Arrivals, _days, refresh
from wattframe.registry import Location, Market
from wattframe.schemas import conform

PLACES = (Location("Here", 44.0, 26.0, 0.5, 0.5, 0.5), Location("There", 45.0, 25.0, 0.5, 0.5, 0.5))
MARKETS = {
    "RO": Market("10YRO-TEST-----X", "Europe/Bucharest", "RON", "Romania", locations=PLACES),
    "DE": Market("10YDE-TEST-----X", "Europe/Berlin", "EUR", "Germany", fx_source="ECB", locations=PLACES),
    "IN": Market("10YIN-TEST-----X", "Asia/Kolkata", "INR", "India", fx_source="ECB", locations=PLACES),
}
START, END = date(2025, 10, 1), date(2025, 12, 15)  # across the autumn changeover and two ends of months
RUN = [datetime(2026, 1, 1), datetime(2026, 1, 2), datetime(2026, 1, 3)]
BUILT = (
    schemas.EXCHANGE_RATES, schemas.FACT_PRICE, schemas.FACT_GENERATION, schemas.FACT_LOAD, schemas.FACT_WEATHER,
    schemas.PRICE_HOURLY, schemas.GENERATION_HOURLY, schemas.BESS_SIGNALS, schemas.ARBITRAGE_WINDOWS,
)


def prices(spark, days, run, markets=tuple(MARKETS), slots=96):
    r = random.Random(run)
    rows = [(m, d, n, float(r.randint(-5, 50)), 1.0) for m in markets for d in days for n in range(1, slots + 1, 5)]
    return stamped(spark, rows, "market_id string, delivery_date date, interval_15min int, price_lei_mwh double, volume_mw double", run)


def readings(spark, instants, run, types=("Solar", "Nuclear"), markets=tuple(MARKETS)):
    r = random.Random(run)
    rows = [(m, t, p, float(r.randint(0, 40) * 4)) for m in markets for t in instants for p in types]
    return stamped(spark, rows, "market_id string, timestamp_utc timestamp, production_type string, actual_mw double", run)


def load(spark, instants, run):
    rows = [(m, t, float((ord(m[0]) + t.hour) % 7 * 4 + run)) for m in MARKETS for t in instants]
    return stamped(spark, rows, "market_id string, timestamp_utc timestamp, actual_load_mw double", run)


def weather(spark, instants, run, places=("Here", "There", "Atlantis")):
    rows = [(m, p, t, k, 5.0 + run) for m in MARKETS for p in places for t in instants for k in ("REALIZED", "FORECAST")]
    return stamped(spark, rows, "market_id string, location_name string, timestamp_utc timestamp, data_type string, temperature_2m double", run)


def quotes(spark, days, run, rate):
    return stamped(spark, [(d, "EUR", rate, 1) for d in days], "date date, foreign_currency string, rate_ron double, multiplier int", run)


def european(spark, days, run, rate):
    rows = [(d, q, rate, d) for d in days for q in ("RON", "INR")]
    return stamped(spark, rows, "date date, quote_currency string, rate double, source_file_date date", run)


def stamped(spark, rows, columns, run):
    return spark.createDataFrame(rows, columns).withColumn("ingested_at", F.lit(RUN[run]))


def arrive(base, table, rows):
    present = [f.name for f in table.schema if f.name not in rows.columns]
    whole = rows.withColumns({c: F.lit(None) for c in present})
    bronze.append(conform(whole, table), table, base, table.month_of or "date")


def arrivals(spark, run):
    """What comes in with each run: first nearly all, then late days and changed values here and there."""
    all_days = [START + timedelta(days=i) for i in range((END - START).days + 1)]
    hours = [datetime(2025, 10, 25, 20) + timedelta(minutes=30 * i) for i in range(60)] + [datetime(2025, 11, 30, h) for h in range(24)]
    if run == 0:
        yield schemas.BNR_RATES, quotes(spark, all_days[2:40:3], 0, 5.0)
        yield schemas.ECB_RATES, european(spark, all_days[0:60:2], 0, 4.0)
        yield schemas.OPCOM_PRICES, prices(spark, [d for d in all_days if d.day not in (7, 30)], 0)
        yield schemas.ENTSOE_GENERATION, readings(spark, hours, 0)
        yield schemas.ENTSOE_LOAD, load(spark, hours, 0)
        yield schemas.WEATHER, weather(spark, [h for h in hours if h.minute == 0], 0)
    elif run == 1:
        yield schemas.OPCOM_PRICES, prices(spark, [date(2025, 10, 7), date(2025, 11, 30)], 1, ("RO", "DE"))
        yield schemas.OPCOM_PRICES, prices(spark, [date(2025, 12, 15)], 1, ("IN",), 10)
        yield schemas.ENTSOE_GENERATION, readings(spark, [datetime(2025, 10, 26, 0, 30), datetime(2025, 10, 31, 23)], 1, ("Solar", "Fusion"), ("RO",))
        yield schemas.ENTSOE_LOAD, load(spark, [datetime(2025, 11, 30, 20)], 1)
        yield schemas.WEATHER, weather(spark, [datetime(2025, 10, 26, 2), datetime(2025, 12, 1, 3)], 1, ("There",))
    else:
        yield schemas.BNR_RATES, quotes(spark, [date(2025, 10, 20), date(2025, 11, 29)], 2, 5.5)


def contents(spark, base, table):
    rows = read_table(spark, table.path(base), schema=table.schema)
    return Counter(map(tuple, rows.drop("processed_at").collect()))


@pytest.fixture(scope="module")
def bases(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("refresh")
    return str(root / "touched"), str(root / "whole")


def files(base, layers=("silver", "gold")):
    return {p: p.stat().st_mtime_ns for layer in layers for p in Path(base, layer).rglob("*.parquet") if "_staging" not in str(p)}


def test_refresh_equals_a_full_build(spark, bases):
    touched, whole = bases
    written = []
    for run in range(3):
        for table, rows in arrivals(spark, run):
            arrive(touched, table, rows)
            arrive(whole, table, rows)
        before = files(touched) if run else {}
        written.append(refresh(spark, touched, START, END, MARKETS, processed_at=RUN[run]))
        if run == 1:
            kept = set(before.items()) & set(files(touched).items())
            folders = {"/".join(p.parts[-3:-1]) for p, _ in kept if "price" in str(p)}
            assert {"market_id=IN/month_id=202510", "market_id=DE/month_id=202512"} <= folders  # not touched
            assert "market_id=RO/month_id=202510" not in {"/".join(p.parts[-3:-1]) for p, _ in kept if "fact_price" in str(p)}
    jobs.build_all(spark, whole, START, END, MARKETS)
    for table in BUILT:
        got, want = contents(spark, touched, table), contents(spark, whole, table)
        assert got == want and got, (table.name, list((got - want).items())[:3], list((want - got).items())[:3])
    assert written[1]["fact_price"] == 2 * 2 * 20 + 20  # two days of two markets, and one of another
    assert written[1]["fact_price"] < written[0]["fact_price"] / 20
    assert set(written[2]) == {"exchange_rates", "fact_price", "price_hourly", "bess_signals", "arbitrage_windows"}


def test_nothing_new_writes_nothing(spark, bases):
    touched, _ = bases
    before = files(touched)
    assert refresh(spark, touched, START, END, MARKETS) == {}
    facts = {p: t for p, t in files(touched).items() if "dim_" not in str(p)}
    assert facts == {p: t for p, t in before.items() if "dim_" not in str(p)}


def test_scans_open_the_touched_months_only(spark, bases):
    touched, _ = bases
    arrive(touched, schemas.OPCOM_PRICES, prices(spark, [date(2025, 11, 3)], 2, ("RO",)).withColumn("ingested_at", F.lit(datetime(2026, 2, 1))))
    new = _Arrivals(spark, touched).of(schemas.OPCOM_PRICES)
    days = _days(new.select("market_id", F.col("delivery_date").alias("day")), START, END)
    assert days.months == [202511] and days.first == days.last == date(2025, 11, 3)
    for rows, count in ((days.observations(spark, touched, schemas.OPCOM_PRICES, MARKETS), 40), (days.facts(spark, touched, schemas.FACT_PRICE), 20)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(month_id" in plan and "(month_id" in plan and "= 202511)" in plan
        assert rows.count() == count
    assert "PushedFilters: [IsNotNull(ingested_at), GreaterThan(ingested_at" in new._jdf.queryExecution().executedPlan().toString()


def test_an_interrupted_run_is_repeated(spark, bases, monkeypatch):
    touched, whole = bases
    late = prices(spark, [date(2025, 10, 9)], 2, ("DE",)).withColumn("ingested_at", F.lit(datetime(2026, 3, 1)))
    for base in bases:
        arrive(base, schemas.OPCOM_PRICES, late)
    arrive(whole, schemas.OPCOM_PRICES, prices(spark, [date(2025, 11, 3)], 2, ("RO",)).withColumn("ingested_at", F.lit(datetime(2026, 2, 1))))
    monkeypatch.setattr("wattframe.plans.gold.bess_signals", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        refresh(spark, touched, START, END, MARKETS)
    monkeypatch.undo()
    assert refresh(spark, touched, START, END, MARKETS)["bess_signals"] > 0
    for build in (jobs.build_fact_price, jobs.build_price_hourly, jobs.build_bess_signals, jobs.build_arbitrage_windows):
        build(spark, whole, None, START, END, markets=MARKETS)
    for table in (schemas.FACT_PRICE, schemas.PRICE_HOURLY, schemas.BESS_SIGNALS, schemas.ARBITRAGE_WINDOWS):
        assert contents(spark, touched, table) == contents(spark, whole, table), table.name
