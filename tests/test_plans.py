"""Landing files to Gold through the jobs, both changeover days included."""

import json
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from wattframe import schemas
from wattframe.operators.quality import duplicate_keys
from wattframe.operators.store import read_table
from wattframe.plans import dims, jobs, queries, reports, silver
from wattframe.registry import (
    MARKETS, Market, get_market, markets_frame, mix_columns, production_types_frame, required_pairs,
)
from wattframe.sources import landing, prices
from wattframe.streaming.ingest import append_stream, hourly_means, landing_stream

TZ = ZoneInfo("Europe/Bucharest")
AUTUMN, SPRING = date(2025, 10, 26), date(2026, 3, 29)
SLOTS = {date(2025, 10, 25): 96, AUTUMN: 100, date(2025, 10, 27): 96}
START, END = date(2025, 10, 25), date(2025, 10, 27)
SOLAR, NUCLEAR, NEW = "Solar", "Nuclear", "Fusion"


def local_hours(start, end):
    """UTC hours of the local days [start, end]."""
    moment = datetime(start.year, start.month, start.day, tzinfo=TZ).astimezone(timezone.utc)
    stop = datetime(end.year, end.month, end.day, tzinfo=TZ) + timedelta(days=1)
    stop = datetime(stop.year, stop.month, stop.day, tzinfo=TZ).astimezone(timezone.utc)
    while moment < stop:
        yield moment.replace(tzinfo=None)
        moment += timedelta(hours=1)


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text))


def price_csv(count, price=lambda n: float(n)):
    head = f'"title"\n\n"{prices.HEADER_CELL}","Interval","a","b","c","d"\n'
    return head + "\n".join(f'"Romania","{n}","{price(n)}","4","2","8"' for n in range(1, count + 1))


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    land = root / "landing"
    for day, count in SLOTS.items():
        write(land / "opcom_pzu" / "RO" / f"{day}.csv", price_csv(count))
    write(land / "opcom_pzu" / "RO" / "2025-10-24.csv", price_csv(24))
    quarter = timedelta(minutes=15)
    records, load = {}, {}
    for hour in local_hours(START - timedelta(days=1), END + timedelta(days=1)):
        for q in range(4):
            at = hour + q * quarter
            day = at.date()
            values = {SOLAR: 100.0 + q, NUCLEAR: 50.0, NEW: 1.0}
            if hour == datetime(2025, 10, 27, 12):
                values = {NEW: 7.0}
            records.setdefault(day, []).extend(
                {"timestamp_utc": at.isoformat(), "production_type": t, "actual_mw": v} for t, v in values.items()
            )
            load.setdefault(day, []).append({"timestamp_utc": at.isoformat(), "actual_load_mw": 1000.0 + q})
    for day in records:
        write(land / "entsoe" / "RO" / "generation" / f"{day}.json", {"records": records[day]})
        write(land / "entsoe" / "RO" / "load" / f"{day}.json", {"records": load[day]})
    for place in ("Dobrogea", "Oltenia", "Atlantis"):
        for hour in local_hours(START, END):
            for kind in ("REALIZED", "FORECAST"):
                day = hour.date()
                path = land / "weather" / "RO" / place / f"{day}.json"
                if kind == "REALIZED" and not path.exists():
                    times = [f"{day}T{h:02d}:00" for h in range(24)]
                    write(path, {"location": place, "lat": 1, "lon": 2, "hourly": {
                        "time": times, "wind_speed_100m": [10.0 if place == "Dobrogea" else 20.0] * 24,
                        "temperature_2m": [5.0] * 24}})
    # The rates stop on the Friday before, so the weekend is carried forward.
    write(land / "bnr_fx_rates" / "2025" / "2025-10-24.xml",
          '<ns0:Cube xmlns:ns0="http://www.bnr.ro/xsd" date="2025-10-24"><ns0:Rate currency="EUR">5.0</ns0:Rate></ns0:Cube>')
    write(land / "bnr_fx_rates" / "2025" / "2025-10-24.json", {"source_url": "http://origin"})
    write(land / "ecb_fx_rates" / "2025-10-27.json",
          {"date": "2025-10-27", "rates": {"RON": 4.0}, "fetched_at": "2025-10-28T00:00:00"})

    base = str(root / "tables")
    def ingest():
        refused = jobs.ingest_prices(spark, str(root), base, None, START - timedelta(days=1), END)
        jobs.ingest_generation_and_load(spark, str(root), base, "RO", START - timedelta(days=1), END + timedelta(days=1))
        jobs.ingest_weather(spark, str(root), base, None, START - timedelta(days=1), END)
        jobs.ingest_bnr_rates(spark, str(root), base, START - timedelta(days=5), END)
        jobs.ingest_ecb_rates(spark, str(root), base, START - timedelta(days=5), END)
        jobs.build_all(spark, base, START, END)
        return refused
    refused = ingest()
    return {"root": str(root), "base": base, "ingest": ingest, "refused": refused}


TABLES = [
    schemas.OPCOM_PRICES, schemas.ENTSOE_GENERATION, schemas.ENTSOE_LOAD, schemas.WEATHER,
    schemas.BNR_RATES, schemas.ECB_RATES, schemas.DIM_DATE, schemas.DIM_DATETIME, schemas.DIM_MARKET,
    schemas.DIM_LOCATION, schemas.DIM_PRODUCTION_TYPE, schemas.EXCHANGE_RATES, schemas.FACT_PRICE,
    schemas.FACT_GENERATION, schemas.FACT_LOAD, schemas.FACT_WEATHER, schemas.PRICE_HOURLY,
    schemas.GENERATION_HOURLY, schemas.BESS_SIGNALS, schemas.ARBITRAGE_WINDOWS,
]


def table(spark, lake, definition):
    return read_table(spark, definition.path(lake["base"]), schema=definition.schema)


def test_a_second_run_changes_nothing(spark, lake):
    before = {t.name: table(spark, lake, t).count() for t in TABLES}
    lake["ingest"]()
    assert {t.name: table(spark, lake, t).count() for t in TABLES} == before
    for t in TABLES:
        assert duplicate_keys(table(spark, lake, t), t.keys).isEmpty(), t.name


def test_bronze(spark, lake):
    done = lake["refused"]
    assert [(r.delivery_date.day, r.reason) for r in done.rejected.collect()] == [(24, "hourly")]
    status = {r.date.day: r.status for r in done.coverage.collect()}
    assert status[24] == "failed" and set(status.values()) >= {"fetched", "failed"}
    assert done.rows > 0 and done.malformed.count() >= 0
    assert table(spark, lake, schemas.OPCOM_PRICES).count() == 96 + 100 + 96
    assert table(spark, lake, schemas.BNR_RATES).first().source_url == "http://origin"


def test_rates_are_carried_over_the_weekend(spark, lake):
    rows = table(spark, lake, schemas.EXCHANGE_RATES).orderBy("date").collect()
    assert [(r.date.day, r.rate, r.source) for r in rows] == [
        (25, 5.0, "FORWARD_FILLED"), (26, 5.0, "FORWARD_FILLED"), (27, 4.0, "ECB")
    ]


def test_prices_sit_on_the_right_instants(spark, lake):
    rows = table(spark, lake, schemas.FACT_PRICE).filter("date_id = 20251026").orderBy("timestamp_utc").collect()
    assert len(rows) == 100
    assert rows[0].timestamp_utc == datetime(2025, 10, 25, 21, 0)
    assert [r.interval_of_day for r in rows] == list(range(1, 101))
    assert all(r.price_eur_mwh == r.price_local_mwh / 5.0 for r in rows)
    hourly = table(spark, lake, schemas.PRICE_HOURLY).filter("date_id = 20251026").orderBy("hour_start_utc").collect()
    assert len(hourly) == 25
    assert [r.is_repeated_hour for r in hourly].count(True) == 1
    third = [r for r in hourly if r.time_label == "03:00"]
    assert [r.price_local_mwh for r in third] == [14.5, 18.5]
    assert sum(r.is_peak for r in hourly) == 12


def test_generation_keeps_every_hour(spark, lake):
    """Local midnight to 03:00 of the first day, 25 autumn hours, and an hour of new types only."""
    facts = table(spark, lake, schemas.FACT_GENERATION)
    assert facts.filter("date_id = 20251025").select("time_id").distinct().count() == 24
    assert facts.filter("date_id = 20251025").agg(F.min("time_id")).first()[0] == 0
    wide = table(spark, lake, schemas.GENERATION_HOURLY)
    autumn = wide.filter("date_id = 20251026").collect()
    assert len(autumn) == 25 and {r.total_mw for r in autumn} == {152.5}
    assert {(r.solar_mw, r.nuclear_mw, r.nuclear_mw_total, r.other_discovered_mw) for r in autumn} == {(101.5, 50.0, 50.0, 1.0)}
    only_new = wide.filter("other_discovered_mw = 7.0").collect()
    assert len(only_new) == 1 and only_new[0].total_mw == 7.0 and only_new[0].renewable_share_pct == 0.0
    assert table(spark, lake, schemas.FACT_LOAD).count() == 73
    types = table(spark, lake, schemas.DIM_PRODUCTION_TYPE)
    assert types.count() == 22 and types.filter(f"production_type_name = '{NEW}'").first().production_type_id == 22


def test_weather_facts_drop_unknown_places(spark, lake):
    rows = table(spark, lake, schemas.FACT_WEATHER)
    assert rows.select("location_id").distinct().count() == 2
    places = table(spark, lake, schemas.DIM_LOCATION)
    national = reports.national_weather(rows, places).first()
    assert national.wind_signal == pytest.approx((10 * 0.70 + 20 * 0.02) / 0.72)
    assert national.solar_signal is None
    joined = reports.weather_hourly(rows, places)
    assert joined.count() == rows.count()


def test_signals_and_windows_on_the_long_day(spark, lake):
    signals = table(spark, lake, schemas.BESS_SIGNALS)
    day = queries.signals(signals, "RO", AUTUMN).collect()
    assert [r.signal for r in day] == [-1] * 8 + [0] * 84 + [1] * 8
    windows = queries.arbitrage_windows(signals, "RO", AUTUMN).orderBy("start_utc").collect()
    assert [(w.type, w.n_slots, w.start_label, w.end_label) for w in windows] == [
        ("charge", 8, "00:00", "01:45"), ("discharge", 8, "22:00", "23:45")
    ]
    assert windows[0].avg_price_eur_mwh == pytest.approx(0.9)
    (nested,) = queries.day_windows(signals, "RO", AUTUMN).collect()
    assert nested.arbitrage_spread_eur_mwh == pytest.approx(99 / 5)
    assert len(nested.charge_windows) == len(nested.discharge_windows) == 1
    assert queries.arbitrage_windows(signals, "RO", date(2031, 1, 1)).isEmpty()
    (idle,) = queries.day_windows(signals.withColumn("signal", F.lit(0)), "RO", AUTUMN).collect()
    assert idle.charge_windows == [] and idle.discharge_windows == []


def test_windows_of_the_repeated_hour_follow_the_instant(spark):
    """Signals alternate with the pass through 03:00; clock order would interleave them."""
    slots = [(n, -1 if 13 <= n <= 16 else 1 if 17 <= n <= 20 else 0) for n in range(1, 101)]
    begin = datetime(2025, 10, 25, 21, 0)
    df = spark.createDataFrame(
        [("RO", 20251026, begin + timedelta(minutes=15 * (n - 1)), s, 1.0, 0.0) for n, s in slots],
        "market_id string, date_id int, timestamp_utc timestamp, signal int, price_eur_mwh double, "
        "arbitrage_spread_eur_mwh double",
    ).withColumn("time_label", F.date_format(F.from_utc_timestamp("timestamp_utc", "Europe/Bucharest"), "HH:mm")
    ).withColumn("time_id", F.lit(0))
    windows = queries.arbitrage_windows(df).orderBy("start_utc").collect()
    assert [(w.type, w.n_slots, w.start_label) for w in windows] == [("charge", 4, "03:00"), ("discharge", 4, "03:00")]


def test_read_side(spark, lake):
    hourly = table(spark, lake, schemas.PRICE_HOURLY)
    rows = queries.prices(hourly, "RO", AUTUMN, AUTUMN).collect()
    assert len(rows) == 25 and {r.currency for r in rows} == {"RON"}
    assert rows == sorted(rows, key=lambda r: r.hour_start_utc)
    assert queries.prices(hourly, "RO", date(2030, 1, 1), date(2030, 1, 2)).isEmpty()
    with pytest.raises(ValueError):
        queries.prices(hourly, "RO", END, START)
    with pytest.raises(ValueError):
        get_market("XX")
    with pytest.raises(ValueError):
        queries.prices(hourly, "XX", START, END)
    mix = queries.generation(table(spark, lake, schemas.GENERATION_HOURLY), "RO", AUTUMN, AUTUMN).first()
    assert len(mix.sources) == 22 and mix.sources["solar_mw"] == 101.5 and "nuclear_mw_total" not in mix.sources


def test_reports(spark, lake):
    price, gen = table(spark, lake, schemas.FACT_PRICE), table(spark, lake, schemas.FACT_GENERATION)
    load, types = table(spark, lake, schemas.FACT_LOAD), table(spark, lake, schemas.DIM_PRODUCTION_TYPE)
    cross = reports.cross_grain(price, gen, types, load)
    assert cross.count() == 73
    row = cross.orderBy("hour_start_utc").first()
    assert (row.avg_price_eur_mwh, row.renewable_share, row.actual_load_mw) == (
        pytest.approx(0.5), pytest.approx(101.5 / 152.5), 1001.5
    )
    weather = table(spark, lake, schemas.WEATHER)
    with_weather = reports.price_with_weather(price, weather)
    assert with_weather.count() == price.count()
    observations = silver.rate_observations(
        spark.createDataFrame([(date(2026, 1, 1), "EUR", 5.0, 1, datetime(2026, 1, 1))],
                              "date date, foreign_currency string, rate_ron double, multiplier int, ingested_at timestamp"),
        spark.createDataFrame([(date(2026, 1, 1), "RON", 5.5, datetime(2026, 1, 1))],
                              "date date, quote_currency string, rate double, ingested_at timestamp"),
    )
    check = reports.rate_cross_check(observations, "BNR", "ECB").first()
    assert check.deviation == pytest.approx(0.1) and check.exceeds
    day = spark.createDataFrame(
        [("RO", date(2026, 1, 1), float(p), 1.0, s) for p, s in [(1, 1.0)] * 30 + [(900, 0.0)]],
        "market_id string, delivery_date date, price_lei_mwh double, volume_buy_mw double, volume_sell_mw double",
    )
    flagged = reports.price_outliers(day).filter("is_price_outlier").collect()
    assert [(r.price_lei_mwh, r.buy_sell_ratio) for r in flagged] == [(900.0, None)]


def test_registry(spark):
    places = dims.dim_location(markets_frame(spark))
    assert places.count() == 6
    sums = places.agg(F.sum("wind_weight"), F.sum("solar_weight"), F.sum("demand_weight")).first()
    assert [round(s, 9) for s in sums] == [1.0, 1.0, 1.0]
    several = {
        **MARKETS,
        "DE": Market("10Y1001A1001A83F", "Europe/Berlin", "EUR", fx_source="ECB"),
        "GB": Market("10YGB----------A", "Europe/London", "GBP", fx_source="ECB"),
    }
    pairs = {tuple(r) for r in required_pairs(markets_frame(spark, several)).collect()}
    assert pairs == {("EUR", "RON", "BNR", "ECB"), ("EUR", "EUR", "SYNTHETIC", None), ("EUR", "GBP", "ECB", None)}
    axis = dims.dim_datetime(markets_frame(spark, several), SPRING, SPRING)
    per_zone = axis.groupBy("timezone").count().collect()
    assert {r.timezone: r["count"] for r in per_zone} == dict.fromkeys(
        ["Europe/Bucharest", "Europe/Berlin", "Europe/London"], 92
    )
    assert markets_frame(spark, several).filter("market_id = 'DE'").first().market_name == "DE"
    types = production_types_frame(spark)
    assert [r.production_type_id for r in types.collect()] == list(range(1, 22))


def executions(spark):
    """Plans of all SQL executions so far, as Spark's own store lists them."""
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [found.apply(i).physicalPlanDescription() for i in range(found.size())]


def test_a_build_reads_its_observations_once(spark, lake):
    builds = (
        (jobs.build_fact_price, schemas.OPCOM_PRICES), (jobs.build_fact_generation, schemas.ENTSOE_GENERATION),
        (jobs.build_fact_weather, schemas.WEATHER),
    )
    for build, observed in builds:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        before = len(executions(spark))
        done = build(spark, lake["base"], None, START, END)
        done.dropped.collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        plans = executions(spark)[before:]
        assert sum(f"/bronze/{observed.name}" in p for p in plans) == 1, build.__name__
    places = {r.key: r.dropped_rows for r in done.dropped.collect()}
    assert set(places) == {"RO/Atlantis"} and places["RO/Atlantis"] > 0


def test_rate_runs_say_which_days_they_found(spark, lake, tmp_path):
    for ingest, found in ((jobs.ingest_bnr_rates, {24}), (jobs.ingest_ecb_rates, {27})):
        done = ingest(spark, lake["root"], str(tmp_path), START - timedelta(days=5), END)
        status = {r.date.day: r.status for r in done.coverage.collect()}
        assert done.rows == 1 and set(status) == set(range(20, 28))
        assert {d for d, s in status.items() if s == "fetched"} == found
        assert set(status.values()) == {"fetched", "missing"}


def test_conform_refuses_nulls(spark):
    df = spark.createDataFrame([(None, date(2026, 1, 1))], "date_id int, full_date date")
    small = schemas.Table("silver", "small", "date_id int not null, full_date date", keys=("date_id",))
    with pytest.raises(Exception, match="NULL in small.date_id"):
        schemas.conform(df, small).collect()


def test_landing_stream_appends_once(spark, lake, tmp_path):
    base, checkpoint = str(tmp_path / "t"), str(tmp_path / "cp")
    table_of = lambda files: prices.accepted_prices(prices.parse_price_files(files))

    def run(checkpoint):
        files = landing_stream(spark, f"{lake['root']}/{landing.OPCOM_PRICES.format(market_id='*')}/*", 2)
        append_stream(files, table_of, schemas.OPCOM_PRICES, base, checkpoint, "delivery_date").awaitTermination()
        return read_table(spark, schemas.OPCOM_PRICES.path(base)).count()

    assert run(checkpoint) == 292
    assert run(checkpoint) == 292  # nothing new
    assert run(str(tmp_path / "cp2")) == 292  # replayed batches add nothing


def test_hourly_means_accept_late_rows(spark, tmp_path):
    schema = "ts timestamp, k string, v double"
    folder = str(tmp_path / "in")
    write_rows = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    at = lambda d, h, m: datetime(2026, 1, d, h, m)
    write_rows([(at(1, 0, 0), "a", 1.0), (at(1, 1, 0), "a", 5.0)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = (
        hourly_means(stream, "ts", ["k"], "v").writeStream.format("memory").queryName("means")
        .outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    try:
        query.processAllAvailable()
        write_rows([(at(1, 0, 30), "a", 3.0), (at(9, 0, 0), "a", 0.0)])
        query.processAllAvailable()
        write_rows([(at(20, 0, 0), "a", 0.0)])
        query.processAllAvailable()
        got = {r.hour_start_utc: (r.v, r.readings) for r in spark.table("means").collect()}
    finally:
        query.stop()
    assert got[at(1, 0, 0)] == (2.0, 2) and got[at(1, 1, 0)] == (5.0, 1)


def test_mix_columns_match_the_stored_schema(spark, lake):
    stored = table(spark, lake, schemas.GENERATION_HOURLY).columns
    assert set(mix_columns().values()) <= set(stored)
