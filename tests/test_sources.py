import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattframe.sources import landing, prices, rates, series

# The lines before the table: a title, and averages of the day over blocks of slots.
HEAD = "\n".join(
    ['"PIP si volum tranzactionat pentru ziua de livrare: 09/03/2031"', "", '"","Pret mediu [lei/MWh]","Volum [MWh]","Rezolutie"']
    + [f'"ROPEX_DAM_{block}","{k}.25","{k * 10}.5","PT15M"' for k, block in enumerate(("Base (1-24)", "Peak (33-80)"), 1)]
    + ["", ""]
)
HEADER = (
    '"Zona de tranzactionare","Interval","Pret de Inchidere a Pietei [lei/MWh]",'
    '"Volum Tranzactionat [MW]","Volum Tranzactionat pe cumparare [MW]",'
    '"Volum Tranzactionat pe vanzare [MW]"'
)


def price_of(slot):
    return 3 * slot + 0.25


def csv_text(count, resolution=True, extra=()):
    """A day of ``count`` slots, whose figures follow from the slot number."""
    rows = [
        ["Romania", i, f"{price_of(i):.2f}", f"{i}.5", f"{i}.125", f"{2 * i}.0", *(["PT15M"] * resolution)]
        for i in range(1, count + 1)
    ]
    lines = [",".join(f'"{cell}"' for cell in row) for row in rows]
    return HEAD + "\n".join([HEADER + ',"Rezolutie"' * resolution, *lines, *extra])


def files(spark, entries):
    return spark.createDataFrame(list(entries), "path string, value string")


def one(spark, text, path="file:/x/landing/opcom_pzu/RO/2026-06-02.csv"):
    return prices.parse_price_files(files(spark, [(path, text)]))


@pytest.mark.parametrize(
    "count, verdict",
    [(96, "accepted"), (100, "accepted"), (92, "accepted"), (23, "hourly"), (24, "hourly"),
     (25, "hourly"), (3, "changed"), (50, "changed"), (91, "changed"), (101, "changed"),
     (200, "changed"), (0, "empty")],
)
def test_resolution_verdict(spark, count, verdict):
    assert one(spark, csv_text(count)).first().verdict == verdict


@pytest.mark.parametrize("resolution", [True, False])
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_price_rows(spark, resolution, newline):
    text = csv_text(96, resolution).replace("\n", newline)
    rows = prices.accepted_prices(one(spark, text)).orderBy("interval_15min").collect()
    assert len(rows) == 96
    first = rows[0]
    assert (first.market_id, first.delivery_date, first.interval_15min) == ("RO", date(2026, 6, 2), 1)
    assert (first.price_lei_mwh, first.volume_mw, first.volume_buy_mw, first.volume_sell_mw) == (
        price_of(1), 1.5, 1.125, 2.0
    )
    assert first.source_url.endswith("/02/06/2026/ro?resolution=15")


def test_odd_price_rows(spark):
    extra = [
        "", '"Romania","97","","1","1","1"', '"Romania","x","1","1","1","1"', '"short","98"',
        ' Romania , 99 ,"2.047,5", 2 ,3,4',
    ]
    days = one(spark, csv_text(96, extra=extra))
    rows = {r.interval_15min: r for r in prices.accepted_prices(days).collect()}
    assert set(rows) == set(range(1, 97)) | {99}
    assert (rows[99].price_lei_mwh, rows[99].volume_sell_mw) == (2047.5, 4.0)
    assert prices.malformed_counts(days).first().malformed_rows == 1


def test_text_without_data_and_one_bad_day_among_good_ones(spark):
    path = "file:/x/landing/opcom_pzu/RO/2026-06-0{}.csv"
    days = prices.parse_price_files(
        files(spark, [(path.format(1), csv_text(96)), (path.format(2), csv_text(24)),
                      (path.format(3), ""), (path.format(4), "no header\n1,2,3,4,5,6")])
    )
    assert prices.accepted_prices(days).count() == 96
    assert [(r.delivery_date.day, r.highest, r.reason) for r in prices.rejected_days(days).collect()] == [
        (2, 24, "hourly")
    ]


def test_generation_and_load(spark):
    path = "file:/x/landing/entsoe/RO/generation/2024-01-15.json"
    body = {"records": [
        {"timestamp_utc": "2024-01-15T00:00:00", "production_type": "Solar", "actual_mw": 31.0},
        {"timestamp_utc": "2024-01-15T00:15:00+00:00", "production_type": "Solar", "actual_mw": None},
        {"timestamp_utc": "2024-01-15T00:30:00", "production_type": "Solar"},
        {"timestamp_utc": "bad", "production_type": "Solar", "actual_mw": 1.0},
        {"production_type": "Solar", "actual_mw": 1.0},
        {"timestamp_utc": "2024-01-15T00:45:00", "actual_mw": 1.0},
        {"timestamp_utc": "2024-01-15T01:00:00", "production_type": "Solar", "actual_mw": "x"},
        7,
    ]}
    frame = files(spark, [(path, json.dumps(body)), (path, "{broken"), (path, '{"records": []}'), (path, "{}")])
    rows = series.parse_generation(frame).orderBy("timestamp_utc").collect()
    assert [(r.market_id, r.timestamp_utc, r.actual_mw) for r in rows] == [
        ("RO", datetime(2024, 1, 15, 0, 0), 31.0),
        ("RO", datetime(2024, 1, 15, 0, 15), None),
        ("RO", datetime(2024, 1, 15, 0, 30), None),
    ]
    load = {"records": [{"timestamp_utc": "2024-01-15T00:00:00", "actual_load_mw": 88.5},
                        {"timestamp_utc": "2024-01-15T00:15:00", "actual_load_mw": None}]}
    got = series.parse_load(files(spark, [(path, json.dumps(load))])).orderBy("timestamp_utc").collect()
    assert [r.actual_load_mw for r in got] == [88.5, None]


RATES = '<Rate currency="EUR">6.25</Rate><Rate currency="JPY" multiplier="100">2.75</Rate><Rate currency="XAU">-</Rate>'


@pytest.mark.parametrize(
    "text, day",
    [
        (f'<?xml version="1.0" encoding="utf-8"?>\n<Cube xmlns="http://www.bnr.ro/xsd" date="2024-01-15">{RATES}</Cube>', 15),
        ('<n:Cube xmlns:n="http://www.bnr.ro/xsd" date="2024-01-15">'
         + RATES.replace("<Rate", "<n:Rate").replace("</Rate", "</n:Rate") + "</n:Cube>", 15),
        (f'<DataSet xmlns="http://www.bnr.ro/xsd"><Cube date="2024-01-15">{RATES}</Cube></DataSet>', 15),
        (f'<Cube xmlns="http://www.bnr.ro/xsd">{RATES}</Cube>', 16),
    ],
)
def test_central_bank_xml(spark, text, day):
    path = "file:/x/landing/bnr_fx_rates/2024/2024-01-16"
    notes = files(spark, [(path + ".json", '{"source_url": "http://origin"}')])
    xml = files(spark, [(path + ".xml", text), (path + ".xml", "broken <")])
    rows = rates.parse_bnr(xml, notes).orderBy("foreign_currency").collect()
    assert [(r.foreign_currency, r.rate_ron, r.multiplier) for r in rows] == [
        ("EUR", 6.25, 1), ("JPY", 2.75, 100)
    ]
    assert {r.date for r in rows} == {date(2024, 1, day)} and rows[0].source_url == "http://origin"
    assert rates.parse_bnr(xml).first().source_url.endswith("nbrfxrates2024.xml")


def test_archive_is_split_into_days_that_parse(spark, tmp_path):
    text = (
        '<?xml version="1.0"?><DataSet xmlns="http://www.bnr.ro/xsd"><Header/><Body>'
        f'<Cube date="2024-01-15">{RATES}</Cube>\n<Cube date="2024-01-12"><Rate currency="EUR">6.25</Rate></Cube>'
        f"<Cube date='2024-01-12'>\n  <Rate currency='EUR'>6.5</Rate></Cube><Cube date='someday'>{RATES}</Cube></Body></DataSet>"
    )
    (tmp_path / "2024.xml").write_text(text)
    days = rates.split_bnr_archive(spark, str(tmp_path / "*.xml"))
    assert {r.date.day for r in days.collect()} == {12, 15}
    parsed = rates.parse_bnr(
        days.select(F.concat(F.lit("f/"), F.col("date").cast("string"), F.lit(".xml")).alias("path"), "value")
    )
    assert {(r.date.day, r.foreign_currency, r.rate_ron) for r in parsed.collect()} == {
        (15, "EUR", 6.25), (15, "JPY", 2.75), (12, "EUR", 6.5)
    }


def test_ecb_files(spark):
    path = "file:/x/landing/ecb_fx_rates/2024-01-16.json"
    good = {"date": "2024-01-15", "fetched_at": "2024-01-17T05:00:00+00:00",
            "rates": {"USD": 1.5, "RON": 8.125, "XXX": "N/A", "YYY": None}}
    rows = rates.parse_ecb(files(spark, [(path, json.dumps(good)), (path, "nope")])).orderBy("quote_currency").collect()
    assert [(r.quote_currency, r.rate) for r in rows] == [("RON", 8.125), ("USD", 1.5)]
    assert rows[0].date == date(2024, 1, 15) and rows[0].source_file_date == date(2024, 1, 17)
    odd = {"date": "someday", "rates": {"USD": 1}}
    row = rates.parse_ecb(files(spark, [(path, json.dumps(odd))]), F.lit(date(2030, 1, 1))).first()
    assert (row.date, row.source_file_date, row.rate) == (date(2024, 1, 16), date(2030, 1, 1), 1.0)


def test_prefixed_archive(spark, tmp_path):
    tagged = RATES.replace("<Rate", "<n:Rate").replace("</Rate", "</n:Rate")
    (tmp_path / "2024.xml").write_text(
        f'<n:DataSet xmlns:n="http://www.bnr.ro/xsd"><n:Cube date="2024-01-15">{tagged}</n:Cube></n:DataSet>'
    )
    (row,) = rates.split_bnr_archive(spark, str(tmp_path)).collect()
    assert row.value.startswith('<n:Cube date="2024-01-15">') and row.value.endswith("</n:Cube>")
    assert row.source_path.endswith("2024.xml")
    parsed = rates.parse_bnr(files(spark, [("f/2024-01-15.xml", row.value)]))
    assert {(r.foreign_currency, r.rate_ron) for r in parsed.collect()} == {("EUR", 6.25), ("JPY", 2.75)}


def test_one_large_file_is_read_by_several_tasks(spark, tmp_path):
    days = [date(1999, 1, 4) + timedelta(days=i) for i in range(3000)]
    history = "".join(
        f'<Cube time="{d}"><Cube currency="USD" rate="{i}.5"/><Cube rate="{i}.25" currency="GBP"></Cube></Cube>\n' for i, d in enumerate(days)
    )
    (tmp_path / "hist.xml").write_text(f"<Envelope><Cube>{history}</Cube></Envelope>")
    archive = "".join(f'<Cube date="{d}"><Rate currency="EUR">{i}.5</Rate></Cube>' for i, d in [*enumerate(days), (9999, days[0])])
    (tmp_path / "years.xml").write_text(f"<DataSet><Body>{archive}</Body></DataSet>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        parsed = rates.parse_ecb_history(spark, str(tmp_path / "hist.xml"))
        assert parsed.rdd.getNumPartitions() > 10
        assert {(r.date, r.quote_currency): r.rate for r in parsed.collect()} == {
            (d, c): i + x for i, d in enumerate(days) for c, x in (("USD", 0.5), ("GBP", 0.25))
        }
        records = rates.day_records(spark, str(tmp_path / "years.xml"), "date")
        assert records.rdd.getNumPartitions() > 5 and records.count() == 3001
        split = {r.date: r.value for r in rates.split_bnr_archive(spark, str(tmp_path / "years.xml")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {d: f'<Cube date="{d}"><Rate currency="EUR">{i}.5</Rate></Cube>' for i, d in enumerate(days)}
    want[days[0]] = want[days[0]].replace(">0.5<", ">9999.5<")  # the last one in the file counts
    assert split == want


def test_ecb_history_and_its_day_files(spark, tmp_path):
    text = (
        '<gesmes:Envelope xmlns:gesmes="http://www.gesmes.org/xml/2002-08-01" '
        'xmlns="http://www.ecb.int/vocabulary/2002-08-01/eurofxref"><gesmes:subject>x</gesmes:subject><Cube>'
        '<Cube time="2024-01-15"><Cube currency="USD" rate="1.5"/><Cube currency="GBP" rate="0.625"/></Cube>'
        '<Cube time="2024-01-12"><Cube currency="USD" rate="1.375"/><Cube currency="GBP" rate="N/A"/></Cube>'
        '<Cube time="2024-01-11"><Cube currency="USD" rate="N/A"/></Cube></Cube></gesmes:Envelope>'
    )
    (tmp_path / "hist.xml").write_text(text)
    history = rates.parse_ecb_history(spark, str(tmp_path / "hist.xml"))
    expected = {(15, "USD", 1.5), (15, "GBP", 0.625), (12, "USD", 1.375)}
    assert {(r.date.day, r.quote_currency, r.rate) for r in history.collect()} == expected
    days = rates.ecb_day_files(history, "http://hist", F.lit("2024-01-16T00:00:00"))
    parsed = rates.parse_ecb(days.select(F.lit("x").alias("path"), "value"))
    assert {(r.date.day, r.quote_currency, r.rate) for r in parsed.collect()} == expected


def test_weather(spark):
    body = {"location": "Oltenia", "lat": 44.32, "lon": 23.8, "hourly": {
        "time": ["2026-06-03T00:00", "2026-06-03T01:00", "2026-06-03T02:00"],
        "temperature_2m": [20.0, None, 22.5], "wind_speed_100m": [5.0],
        "cloud_cover": [1, 2, 3, 4, 5],
    }}
    path = "file:/x/landing/weather/RO/Oltenia/2026-06-03.json"
    forecast = {**body, "data_type": "FORECAST", "source_url": "u"}
    frame = files(spark, [(path, json.dumps(body)), (path, json.dumps(forecast)), (path, "{")])
    rows = series.parse_weather(frame).orderBy("data_type", "timestamp_utc").collect()
    assert [r.data_type for r in rows] == ["FORECAST"] * 3 + ["REALIZED"] * 3
    real = rows[3:]
    assert [r.temperature_2m for r in real] == [20.0, None, 22.5]
    assert [r.wind_speed_100m for r in real] == [5.0, None, None]
    assert [r.wind_speed_10m for r in real] == [None] * 3
    assert [r.cloud_cover for r in real] == [1.0, 2.0, 3.0]
    assert (real[0].lat, real[0].source_url, rows[0].source_url) == (44.32, None, "u")


def test_melt_load_series_and_days(spark):
    wide = spark.createDataFrame(
        [(datetime(2026, 6, 2, 23, 0), 1.0, float("nan")), (datetime(2026, 6, 3, 0, 0), 2.0, 3.0)],
        "ts timestamp, a double, b double",
    )
    long = series.generation_long(wide, "ts", {"a": ("Solar", ""), "b": ("Hydro Pumped Storage", "Actual Consumption")})
    got = {(r.timestamp_utc.day, r.production_type): r.actual_mw for r in long.collect()}
    assert got == {(2, "Solar"): 1.0, (2, "Hydro Pumped Storage|Actual Consumption"): None,
                   (3, "Solar"): 2.0, (3, "Hydro Pumped Storage|Actual Consumption"): 3.0}
    load = series.load_series(wide.select("ts", "b", "a"), "ts").orderBy("timestamp_utc").collect()
    assert [r.actual_load_mw for r in load] == [None, 3.0]
    assert [r.a for r in series.on_utc_day(wide, date(2026, 6, 3), "ts").collect()] == [2.0]
    tagged = series.weather_days(wide, date(2026, 6, 3), "ts").orderBy("ts").collect()
    assert [(r.date.day, r.data_type) for r in tagged] == [(2, "REALIZED"), (3, "FORECAST")]


def test_reading_and_writing_slices(spark, tmp_path):
    folder = tmp_path / "landing" / "opcom_pzu" / "RO"
    folder.mkdir(parents=True)
    for day in (1, 2, 3):
        (folder / f"2026-06-0{day}.csv").write_text(csv_text(96))
    read = landing.read_files(
        spark, str(tmp_path), landing.OPCOM_PRICES, date(2026, 6, 2), date(2026, 6, 3), market_id="RO"
    )
    assert sorted(r.d.day for r in read.select(landing.file_date().alias("d")).collect()) == [2, 3]
    assert landing.read_files(spark, str(tmp_path), landing.OPCOM_PRICES, market_id="DE").isEmpty()

    target = str(tmp_path / "out" / "landing" / "opcom_pzu")
    slices = lambda *rows: spark.createDataFrame(
        [(m, date(2026, 6, d), v) for m, d, v in rows], "market_id string, date date, value string"
    )
    on = ["market_id", "date"]
    landing.write_slices(slices(("RO", 1, csv_text(96)), ("RO", 2, csv_text(24))), target, on)
    landing.write_slices(slices(("RO", 2, csv_text(96)), ("RO", 3, csv_text(92))), target, on)
    back = landing.read_files(spark, str(tmp_path / "out"), landing.OPCOM_PRICES)
    verdicts = lambda: {
        (r.market_id, r.delivery_date.day): (r.verdict, r.highest) for r in prices.parse_price_files(back).collect()
    }
    assert verdicts() == {("RO", 1): ("accepted", 96), ("RO", 2): ("hourly", 24), ("RO", 3): ("accepted", 92)}
    landing.write_slices(slices(("RO", 2, csv_text(96))), target, on, refetch=True)
    back = landing.read_files(spark, str(tmp_path / "out"), landing.OPCOM_PRICES)
    assert verdicts()[("RO", 2)] == ("accepted", 96) and len(verdicts()) == 3
