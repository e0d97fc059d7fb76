import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wattframe.operators import quality
from wattframe.operators.fill import asof_join, forward_fill, reconcile_rates
from wattframe.operators.rank import with_signals
from wattframe.operators.resolve import (
    assign_stable_ids, number_in_order, resolve, unresolved, unresolved_counts,
)
from wattframe.operators.runs import collapse_runs
from wattframe.operators.latest import latest_per_key
from wattframe.operators.versions import known_when, state_at, validity
from wattframe.operators.usage import admission, over_limit, requests_since, trailing_requests, usage_summary
from wattframe.operators.wide import as_map, melt, share_pct, wide_mix

SLOW = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
T0 = datetime(2026, 1, 1)


# ---- signals -------------------------------------------------------------------


def expected_signals(prices, charge, discharge):
    order = sorted((i for i, p in enumerate(prices) if p is not None), key=lambda i: (prices[i], i))
    out = [0] * len(prices)
    for place in order[max(len(order) - discharge, 0):] if discharge else []:
        out[place] = 1
    for place in order[:charge]:
        out[place] = -1
    return out


def signals_of(spark, prices, charge=8, discharge=8):
    rows = [(1, T0 + timedelta(minutes=15 * i), p) for i, p in enumerate(prices)]
    df = spark.createDataFrame(rows, "day int, timestamp_utc timestamp, price_eur_mwh double")
    return with_signals(df, ["day"], charge_slots=charge, discharge_slots=discharge).orderBy("timestamp_utc").collect()


@pytest.mark.parametrize(
    "prices, charge, discharge, expected",
    [
        ([i * 1.5 - 20 for i in range(100)], 7, 9, [-1] * 7 + [0] * 84 + [1] * 9),
        ([None] * 96, 8, 8, [0] * 96),
        ([None, 7.5, None, -3.0, 40.0, None], 2, 2, [0, -1, 0, -1, 1, 0]),
        ([5.0] * 96, 2, 2, [-1, -1] + [0] * 92 + [1, 1]),
        ([7.0], 1, 1, [-1]),
        ([10.0, -50.0, 20.0, -60.0, 5.0], 2, 1, [0, -1, 1, -1, 0]),
    ],
)
def test_signal_cases(spark, prices, charge, discharge, expected):
    assert [r.signal for r in signals_of(spark, prices, charge, discharge)] == expected


@SLOW
@given(
    st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float)), min_size=1, max_size=40),
    st.integers(0, 10), st.integers(0, 10),
)
def test_signals_equal_a_stable_sort(spark, prices, charge, discharge):
    rows = signals_of(spark, prices, charge, discharge)
    assert [r.signal for r in rows] == expected_signals(prices, charge, discharge)
    valid = [p for p in prices if p is not None]
    order = sorted((i for i, p in enumerate(prices) if p is not None), key=lambda i: (prices[i], i))
    for i, row in enumerate(rows):
        place = order.index(i) + 1 if i in order else None
        assert row.price_rank_asc == place
        assert row.price_rank_desc == (len(order) - place + 1 if place else None)
        assert row.daily_min_price_eur_mwh == (min(valid) if valid else None)
        assert row.arbitrage_spread_eur_mwh == (max(valid) - min(valid) if valid else None)


def test_ranking_costs_one_shuffle_and_one_sort(spark):
    df = spark.range(10).selectExpr("id % 2 day", "timestamp_seconds(id) timestamp_utc", "double(id) price_eur_mwh")
    plan = with_signals(df, ["day"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


# ---- runs ----------------------------------------------------------------------


def test_runs(spark):
    values = [-1, -1, 0, -1, None, None, 1, 1, 1]
    df = spark.createDataFrame([(1, i * 2, v) for i, v in enumerate(values)], "g int, t int, v int")
    got = collapse_runs(df, ["g"], "t", "v", [F.count("*").alias("n"), F.min("t").alias("t0")]).orderBy("t0").collect()
    assert [(r.v, r.n, r.t0) for r in got] == [(-1, 2, 0), (0, 1, 4), (-1, 1, 6), (None, 2, 8), (1, 3, 12)]


# ---- rates, fill, as-of ----------------------------------------------------------

PAIR = ("EUR", "RON")
OBS = "date date, base_currency string, quote_currency string, source string, rate double"
PAIRS = "base_currency string, quote_currency string, primary_source string, secondary_source string"


def reconciled(spark, seen, start, end, primary="BNR", secondary="ECB"):
    day = lambda n: date(2026, 1, n)
    obs = spark.createDataFrame([(day(d), *PAIR, s, r) for d, s, r in seen], OBS)
    pairs = spark.createDataFrame([(*PAIR, primary, secondary)], PAIRS)
    rows = reconcile_rates(obs, pairs, day(start), day(end)).orderBy("date").collect()
    return [(r.date.day, r.rate, r.source) for r in rows]


def test_reconcile(spark):
    fill = "FORWARD_FILLED"
    assert reconciled(spark, [(5, "BNR", 5.0), (5, "ECB", 5.1)], 5, 5) == [(5, 5.0, "BNR")]
    assert reconciled(spark, [(5, "BNR", 5.0), (6, "ECB", 5.1)], 5, 6) == [(5, 5.0, "BNR"), (6, 5.1, "ECB")]
    assert reconciled(spark, [(5, "BNR", 5.0)], 5, 7) == [(5, 5.0, "BNR"), (6, 5.0, fill), (7, 5.0, fill)]
    assert reconciled(spark, [(16, "BNR", 5.0)], 17, 18) == [(17, 5.0, fill), (18, 5.0, fill)]
    assert reconciled(spark, [(6, "BNR", 5.0)], 5, 6) == [(6, 5.0, "BNR")]
    assert reconciled(spark, [(1, "BNR", 5.0)], 28, 28) == [(28, 5.0, fill)]  # however old
    assert reconciled(spark, [(1, "BNR", 5.0), (3, "ECB", 5.2)], 28, 28) == [(28, 5.2, fill)]
    assert reconciled(spark, [(20, "BNR", 5.0)], 18, 19) == []
    assert reconciled(spark, [(5, "ECB", 5.0)], 5, 5, "SYNTHETIC", None) == [(5, 1.0, "SYNTHETIC")]
    assert reconciled(spark, [(5, "ECB", 5.0)], 5, 5, "BNR", None) == []


@SLOW
@given(
    st.lists(
        st.tuples(st.sampled_from("ab"), st.integers(0, 200), st.one_of(st.none(), st.integers(0, 9))),
        max_size=40, unique_by=lambda r: r[:2],
    )
)
def test_chunked_fill_equals_a_walk(spark, rows):
    df = spark.createDataFrame([(k, T0 + timedelta(hours=h), v) for k, h, v in rows], "k string, t timestamp, v int")
    expected, last = {}, {}
    for k, h, v in sorted(rows):
        last[k] = v if v is not None else last.get(k)
        expected[(k, T0 + timedelta(hours=h))] = last[k]
    for chunk in (None, "day", "month"):
        got = forward_fill(df, ["k"], "t", ["v"], chunk)
        assert got.columns == df.columns
        assert {(r.k, r.t): r.v for r in got.collect()} == expected


@SLOW
@given(
    st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 100)), max_size=30),
    st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 100), st.integers(0, 9)), max_size=15),
    st.sampled_from([("day", 1), ("day", 3), ("hour", 1)]),
)
def test_asof_equals_brute_force(spark, left, right, how):
    at = lambda h: T0 + timedelta(hours=h)
    ldf = spark.createDataFrame([(i, k, at(h)) for i, (k, h) in enumerate(left)], "i int, k string, t timestamp")
    rdf = spark.createDataFrame([(k, at(h), v, v * 10) for k, h, v in right], "k string, t timestamp, v int, w int")
    expected = {}
    for i, (k, h) in enumerate(left):
        known = [(rh, v) for rk, rh, v in right if rk == k and rh <= h]
        expected[i] = max(known)[1] if known else None
    rows = asof_join(ldf, rdf, ["k"], "t", ["v", "w"], chunk=how[0], salts=how[1]).collect()
    assert {r.i: r.v for r in rows} == expected and len(rows) == len(left)
    assert all(r.w == (None if r.v is None else r.v * 10) for r in rows)


# ---- wide ------------------------------------------------------------------------


def test_wide_mix_keeps_unlisted_hours_and_null_names(spark):
    rows = [
        (1, "A", 10.0, True, "R"), (1, "B", None, False, "T"), (1, "X", 5.0, False, "O"),
        (1, None, 2.0, None, None), (2, "X", 3.0, False, "O"), (3, "A", None, True, "R"),
    ]
    df = spark.createDataFrame(rows, "h int, name string, mw double, ren boolean, cat string")
    wide = wide_mix(df, ["h"], "name", "mw", {"A": "a_mw", "B": "b_mw"},
                    {"renewable_mw": F.col("ren"), "thermal_mw": F.col("cat") == "T"})
    wide = wide.withColumn("share", share_pct("renewable_mw", "total_mw"))
    got = {r.h: r for r in wide.collect()}
    assert (got[1].a_mw, got[1].b_mw, got[1].other_discovered_mw, got[1].total_mw) == (10.0, 0.0, 5.0, 17.0)
    assert got[1].renewable_mw == 10.0 and got[1].share == 10.0 / 17.0 * 100.0
    assert (got[2].a_mw, got[2].other_discovered_mw, got[2].renewable_mw) == (0.0, 3.0, 0.0)
    assert got[3].total_mw is None and got[3].share is None
    long = melt(wide.select("h", "a_mw", "b_mw"), ["h"], ["a_mw", "b_mw"], "name", "mw")
    assert {(r.h, r.name): r.mw for r in long.collect()}[(1, "a_mw")] == 10.0
    assert wide.filter("h = 2").select(as_map(["a_mw", "b_mw"])).first()[0] == {"a_mw": 0.0, "b_mw": 0.0}


# ---- keys ------------------------------------------------------------------------


def test_resolve_and_rejects(spark):
    facts = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "name string, v int")
    dim = spark.createDataFrame([("a", 7)], "name string, id int")
    assert [r.id for r in resolve(facts, dim, ["name"]).collect()] == [7]
    assert {r.v for r in unresolved(facts, dim, ["name"]).collect()} == {2, 3, 4}
    assert {(r.name, r.dropped_rows) for r in unresolved_counts(facts, dim, ["name"]).collect()} == {("b", 2), (None, 1)}


def test_number_in_order(spark):
    rng = random.Random(1)
    names = sorted({"".join(rng.choices("abcé", k=rng.randint(1, 5))) for _ in range(200)})
    df = spark.createDataFrame([(n,) for n in names], "n string").repartition(7)
    got = {r.n: r.position for r in number_in_order(df, "n").collect()}
    assert got == {n: i for i, n in enumerate(names, 1)}
    holes = spark.createDataFrame([("a",), (None,), ("b",)], "n string")
    assert {r.n: r.position for r in number_in_order(holes, "n").collect()} == {"a": 1, "b": 2}
    assert number_in_order(holes.filter("false"), "n").collect() == []


def test_stable_ids(spark):
    types = "name string, id int"
    fixed = spark.createDataFrame([("Solar", 1), ("Wind", 2)], types)
    seen = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    none = spark.createDataFrame([], types)
    ids = lambda df: {r.name: r.id for r in df.collect()}
    first = assign_stable_ids(fixed, seen("Solar", "M", "M", None, "Z"), none, "name", "id")
    assert ids(first) == {"M": 3, "Z": 4}
    stored = fixed.unionByName(first)
    assert ids(assign_stable_ids(fixed, seen("A", "M", "Z", "Wind"), stored, "name", "id")) == {"A": 5, "M": 3, "Z": 4}
    assert ids(assign_stable_ids(fixed, seen("Solar"), stored, "name", "id")) == {}


# ---- usage -----------------------------------------------------------------------

EVENTS = "key_id long, occurred_at timestamp, status_code int, duration_ms double"


def test_usage_summary(spark):
    rows = [(1, T0, 200, 10.0), (1, T0 + timedelta(days=1), 404, 20.25), (None, T0, 500, 5.0),
            (9, T0, 399, 1.0), (9, T0, 200, 1.0), (9, T0, 400, 1.0)]
    events = spark.createDataFrame(rows, EVENTS)
    keys = spark.createDataFrame([(1, "sk_a", "A", 2)], "id long, display string, name string, rate_limit_per_min int")
    got = [tuple(r)[:5] for r in usage_summary(events, keys).collect()]
    assert got == [("<unauthenticated>", "-", 3, 1, 1.0), ("sk_a", "A", 2, 1, 15.1), ("<unauthenticated>", "-", 1, 1, 5.0)]
    later = usage_summary(events, keys, T0 + timedelta(hours=1)).collect()
    assert [(r.key_display, r.requests) for r in later] == [("sk_a", 1)]
    assert {r.key_id: r.n for r in requests_since(events, T0 + timedelta(hours=1)).collect()} == {1: 1}


def test_trailing_count_equals_brute_force(spark):
    rng = random.Random(3)
    times = [(rng.choice([1, 2, None]), rng.randint(0, 900) * 1_000_000 + rng.choice([0, 0, 1])) for _ in range(400)]
    times += [(1, 60_000_000), (1, 0), (1, 59_999_999 + 1)]
    rows = [(k, T0 + timedelta(microseconds=us), 200, 1.0) for k, us in times]
    events = spark.createDataFrame(rows, EVENTS)
    want = sorted(
        sum(1 for k2, u2 in times if k2 == k and us - 60_000_000 < u2 <= us) for k, us in times
    )
    for chunk in (60, 77, 3600):
        got = trailing_requests(events, 60, chunk)
        assert got.columns == [*events.columns, "recent"]
        assert sorted(r.recent for r in got.collect()) == want
    with pytest.raises(ValueError):
        trailing_requests(events, 60, 30)
    keys = spark.createDataFrame([(1, 1), (2, 10_000)], "id long, rate_limit_per_min int")
    assert [r.key_id for r in over_limit(events, keys).collect()] == [1]


def answers(rows, limits, span):
    """What a limiter answers, one request after the other; refused ones don't count."""
    found, queues = [], {}
    for key, now, i in sorted(rows, key=lambda r: (r[1], r[2])):
        limit = limits.get(key)
        if limit is None:
            found.append((key, now, i, True, None, None, 0))
            continue
        queue = [t for t in queues.get(key, []) if t > now - span]
        if len(queue) < limit:
            queue.append(now)
            found.append((key, now, i, True, limit, limit - len(queue), 0))
        else:
            wait = max(1, (queue[0] + span - now) // 1_000_000 + 1) if queue else None
            found.append((key, now, i, False, limit, 0, wait))
        queues[key] = queue
    return Counter(found)


@pytest.mark.parametrize("chunk", [60, 61, 600, 86400])
def test_admission_equals_a_limiter(spark, chunk):
    rng = random.Random(chunk)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, 5, None]), rng.randint(0, 5400) * 1_000_000 + rng.choice([0, 0, 1, 999_999]), i) for i in range(3000)]
    rows += [(1, 60_000_000, 5000), (1, 120_000_000, 5001), (1, 120_000_000, 5002)]
    rows += [(6, 10_000_000 * i, 6000 + i) for i in range(300)]  # beyond its limit all the time
    limits = {1: 12, 2: 3, 3: 0, 4: 1000, 6: 2, 9: 1}
    events = spark.createDataFrame([(k, T0 + timedelta(microseconds=us), i) for k, us, i in rows], "key_id long, occurred_at timestamp, i long")
    named = spark.createDataFrame(list(limits.items()), "key_id long, limit int")
    got = admission(events, named, ["i"], 60, chunk)
    assert got.columns == [*events.columns, "allowed", "limit", "remaining", "retry_after"]
    micros = timedelta(microseconds=1)
    found = Counter((r.key_id, (r.occurred_at - T0) // micros, *r[2:]) for r in got.collect())
    want = answers(rows, limits, 60_000_000)
    assert found == want and {r[3] for r in want} == {True, False}


def test_admission_of_nothing(spark):
    events = spark.createDataFrame([], "key_id long, occurred_at timestamp, i long")
    named = spark.createDataFrame([(1, 5)], "key_id long, limit int")
    assert admission(events, named, ["i"]).collect() == []
    some = spark.createDataFrame([(None, T0, 1), (7, T0, 2)], events.schema)
    assert [(r.allowed, r.remaining, r.retry_after) for r in admission(some, named, ["i"]).collect()] == [(True, None, 0)] * 2


# ---- versions ----------------------------------------------------------------------


@pytest.mark.parametrize("chunk", ["day", "month", "year"])
def test_states_at_any_instant_equal_the_latest_until_then(spark, chunk):
    rng = random.Random(1)
    rows = [
        (rng.choice(["a", "b", None]), rng.randint(0, 3), T0 + timedelta(hours=rng.randint(0, 2400)), rng.choice([1.0, 2.0, None]))
        for _ in range(400)
    ] + [("only", 1, T0, 5.0)]
    df = spark.createDataFrame(rows, "k string, n long, ingested_at timestamp, v double")
    spans = validity(df, ["k", "n"], tiebreak=["v"], chunk=chunk)
    assert spans.columns == [*df.columns, "valid_from", "valid_to"]
    spans = spark.createDataFrame(spans.collect(), spans.schema)
    assert spans.filter("valid_to <= valid_from").isEmpty()
    assert spans.filter("valid_to IS NULL").count() == df.select("k", "n").distinct().count()
    for at in (T0 - timedelta(hours=1), T0, T0 + timedelta(hours=777), T0 + timedelta(days=300)):
        want = latest_per_key(df.filter(F.col("ingested_at") <= F.lit(at)), ["k", "n"], tiebreak=["v"])
        assert Counter(map(tuple, state_at(spans, at).collect())) == Counter(map(tuple, want.collect()))


def test_facts_get_what_was_known_then(spark):
    facts = spark.createDataFrame([(1, T0 + timedelta(hours=h)) for h in (0, 5, 7, 100)] + [(2, T0), (None, T0)], "k long, at timestamp")
    seen = spark.createDataFrame([(1, T0 + timedelta(hours=5), 5.0), (1, T0 + timedelta(hours=8), 8.0), (2, T0 + timedelta(days=9), 2.0)], "k long, ingested_at timestamp, v double")
    got = known_when(facts, seen, ["k"], "at", ["v"]).collect()
    assert {(r.k, (r.at - T0) // timedelta(hours=1)): r.v for r in got} == {(1, 0): None, (1, 5): 5.0, (1, 7): 5.0, (1, 100): 8.0, (2, 0): None, (None, 0): None}


# ---- reports ---------------------------------------------------------------------


def test_coverage_and_quality(spark):
    days = spark.createDataFrame([("s", date(2026, 1, d)) for d in range(1, 5)], "source string, date date")
    tried = spark.createDataFrame(
        [("s", date(2026, 1, 1), "failed"), ("s", date(2026, 1, 1), "fetched"),
         ("s", date(2026, 1, 2), "failed"), ("s", date(2026, 1, 3), "skipped")],
        "source string, date date, status string",
    )
    on = ["source", "date"]
    got = {r.date.day: r.status for r in quality.coverage(days, tried, on).collect()}
    assert got == {1: "fetched", 2: "failed", 3: "skipped", 4: "missing"}
    assert [r.date.day for r in quality.missing_days(days, tried, on).collect()] == [4]

    df = spark.createDataFrame([(1, 5.0), (1, None), (2, -1.0), (3, 11.0)], "k int, v double")
    assert [(r.k, r.copies) for r in quality.duplicate_keys(df, ["k"]).collect()] == [(1, 2)]
    (bad,) = quality.range_violations(df, {"v": (0.0, 10.0)}).collect()
    assert (bad.column, bad.nulls, bad.below, bad.above) == ("v", 1, 1, 1)
    (stats,) = quality.profile(df, ["v"]).collect()
    assert (stats.rows, stats.nulls, stats.low, stats.median, stats.high) == (4, 1, -1.0, 5.0, 11.0)


def test_quantiles_are_exact(spark):
    rng = random.Random(3)
    values = [rng.choice([rng.random(), 0.5, 7.0]) for _ in range(777)]
    df = spark.createDataFrame([(v, float(i % 3)) for i, v in enumerate(values)], "v double, w double").repartition(5)
    got = {r.column: (r.q1, r.median, r.q3) for r in quality.profile(df, ["v", "w"]).collect()}
    at = lambda xs: tuple(sorted(xs)[-(-len(xs) * k // 4) - 1] for k in (1, 2, 3))
    assert got == {"v": at(values), "w": at([i % 3 for i in range(777)])}
    (none,) = quality.profile(df.filter("false"), ["v"]).collect()
    assert (none.rows, none.median) == (0, None)


def test_slot_reports(spark):
    days = [(date(2026, 3, 29), n) for n in range(1, 97)] + [(date(2025, 10, 26), n) for n in range(1, 101)]
    df = spark.createDataFrame([(d, n, "Europe/Bucharest") for d, n in days], "d date, n int, tz string")
    misses = quality.axis_misses(df, "d", "n", "tz").collect()
    assert {(r.d, r.n) for r in misses} == {(date(2026, 3, 29), n) for n in range(93, 97)}
    per_day = {r.d: (r.stored, r.expected, r.complete) for r in quality.slots_per_day(df, "d", "tz", []).collect()}
    assert per_day == {date(2026, 3, 29): (96, 92, False), date(2025, 10, 26): (100, 100, True)}
