"""Queries over a table that repeats the events with shifted keys: boots are dense, and events share their times."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from devicelogs import queries as q
from devicelogs.functions import algorithms as G
from devicelogs.operators import distribution as D
from devicelogs.plans import alarms as A
from devicelogs.plans import ambient as M
from devicelogs.streaming import stateful as T

SF = "/root/testdata/sf0.001"
COPIES = 6


@pytest.fixture(scope="module")
def dense(tmp_path_factory):
    """The folder, and DuckDB over it."""
    path, c = tmp_path_factory.mktemp("dense"), duckdb.connect()
    c.execute(f"copy (select event_id + i * 100000 as event_id, ts, user_id + i * 1500 as user_id, event_type, value, props from '{SF}/events.parquet', (select unnest(range({COPIES})) as i)) to '{path}/events.parquet' (format parquet)")
    c.execute(f"create view events as select * from '{path}/events.parquet'")
    return str(path), c


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """As dense, of one boot with 5,000 events in six days: windows hold thousands of readings."""
    path, c = tmp_path_factory.mktemp("crowded"), duckdb.connect()
    rows = """select i as event_id, timestamp '2024-01-01' + to_microseconds((i * 100000000 + hash(i) % 90000000)::bigint) as ts, 40 as user_id, ['click', 'view', 'error', 'signup', 'purchase'][(hash(i, 1) % 5 + 1)::bigint] as event_type,
        (hash(i, 2) % 9000) / 100.0 as value, '{"k": ' || (hash(i, 3) % 100)::varchar || '}' as props from range(5000) t(i)"""
    c.execute(f"copy ({rows}) to '{path}/events.parquet' (format parquet)")
    c.execute(f"create view events as select * from '{path}/events.parquet'")
    return str(path), c


def shuffled(spark) -> int:
    """Bytes that the session has written for shuffles so far."""
    sc = spark.sparkContext
    jvm, store = sc._jvm, sc._jsc.sc().statusStore()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList()).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteBytes()
    return total


def bag(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str([r[k] for k in order]) for r in rows)


@pytest.mark.parametrize("name", ["nested_holds", "nested_mean_hold", "nested_hold_cpu", "distribution_snapshot", "trailing_percentile", "alarm_temps", "readings_by_percent", "evaluate_algorithms", "evaluate_vectorized", "stateful_alarm_temps", "stateful_trailing_distribution"])
def test_query_equals_sql(spark, dense, name):
    path, c = dense
    got, want = q.queries()[name](spark, path), c.sql(q.oracle_sql()[name])
    rows = bag(want.fetchall(), want.columns)
    assert rows and bag(map(tuple, got.collect()), got.columns) == rows


def test_holds_follow_the_log_and_not_the_clock(spark):
    """The second alarm's lines come after the first's in the log, with times that lie between them."""
    rows = [("off", "unplugged", None, 0, 0, None)]
    for k, t in enumerate((10.0, 10.5)):
        rows += [(None, None, what, t + i, lock + 2 * k, f"k{k}") for i, (what, lock) in enumerate((("alarm", 0), ("acquire", 1), ("acquire", 2), ("release", 1), ("release", 2)))]
    rows.append((None, None, None, 60.0, 0, None))
    log = spark.createDataFrame([("d", "b", i + 1, float(i), i, int(t * 1_000_000), screen, charge, what, 7, lock, key) for i, (screen, charge, what, t, lock, key) in enumerate(rows)],
        "device_id string, boot_id string, token long, trace_time double, line_id long, ts_us long, screen string, charge string, what string, pid long, lock long, alarm_key string")
    found = M.wakelock_holds(log).select("alarm_key", F.col("acquire_us") / 1e6, F.col("release_us") / 1e6).collect()
    assert sorted(map(tuple, found)) == [("k0", 11.0, 14.0), ("k1", 11.5, 14.5)]


@pytest.mark.parametrize("name", ["distribution_snapshot", "trailing_percentile", "alarm_temps", "readings_by_percent", "evaluate_algorithms", "evaluate_vectorized", "algorithm_results"])
def test_windows_are_not_shuffled_reading_by_reading(spark, crowded, name):
    path, c = crowded
    before = shuffled(spark)
    frame = q.queries()[name](spark, path)
    rows, want = frame.collect(), c.sql(q.oracle_sql()[name])
    assert shuffled(spark) - before < 1_000_000
    assert rows and bag(map(tuple, rows), frame.columns) == bag(want.fetchall(), want.columns)


@pytest.mark.parametrize("kind", ["int", "double"])
def test_trailing_percentiles_against_their_definition(spark, kind):
    """Over chunk borders, with empty windows and missing temperatures, which are behind all others."""
    rng, day = random.Random(5), 86_400_000_000
    temps = [("d", "b", rng.randint(0, 30) * day // 2, rng.choice([None, *range(20, 29)]) if kind == "int" else rng.randint(20, 28) / 2) for _ in range(300)]
    probes = [("d", rng.choice("bbbc"), k, rng.randint(-4, 40) * day // 2) for k in range(60)]
    readings = spark.createDataFrame(temps, f"device_id string, boot_id string, ts_us long, temp {kind}")
    got = D.trailing_percentile(spark.createDataFrame(probes, "device_id string, boot_id string, probe_id long, at_us long"), readings, [90, 0, 50])
    want = {}
    for _, boot, probe, at in probes:
        held = sorted((t for _, b, ts, t in temps if b == boot and at - day <= ts <= at), key=lambda t: (t is None, t))
        for p in (0, 50, 90):
            if held:
                want[probe, p] = held[max(-(-len(held) * p // 100), 1) - 1]
    assert {(r.probe_id, r.p): r.percentile_temp for r in got.collect()} == want


def test_snapshots_are_the_readings_of_the_window(spark):
    rng, day = random.Random(6), 86_400_000_000
    temps = [("d", "b", rng.randint(0, 40) * day // 4, rng.randint(20, 29)) for _ in range(200)]
    probes = [("d", "b", k, rng.randint(-4, 60) * day // 4) for k in range(50)]
    readings, at = spark.createDataFrame(temps, "device_id string, boot_id string, ts_us long, temp int"), spark.createDataFrame(probes, "device_id string, boot_id string, probe_id long, at_us long")
    begun = min(t for _, _, t, _ in temps)
    want = {p: (sorted((ts, t) for _, _, ts, t in temps if u - day <= ts <= u), u - begun > day) for _, _, p, u in probes}
    want = {p: w for p, w in want.items() if w[0]}
    got = D.distribution_snapshot(readings, at).collect()
    assert {r.probe_id: (list(zip(r.ts_us, r.temp)), r.is_full) for r in got} == want and all(r.num_entries == len(r.temp) for r in got)
    assert {r.probe_id: (r.sum_temp, r.num_entries, r.is_full) for r in D.distribution_sums(readings, at).collect()} == {p: (sum(t for _, t in held), len(held), full) for p, (held, full) in want.items()}


@pytest.fixture(scope="module")
def alarmed(spark):
    """Alarms over nineteen days, more than a chunk, and readings, some of which share a time or have no temperature."""
    rng, hour = random.Random(8), 3_600_000_000
    temps = [("d", b, rng.randint(0, 900) * hour // 2, rng.choice([None, *range(20, 60)])) for b in "ab" for _ in range(700)]
    alarms = [("d", rng.choice("abc"), str(k), t := rng.randint(0, 900) * hour // 2, (w := rng.randint(1, 90)) * 3_600_000, t, t + w * hour, 0) for k in range(80)]
    return (spark.createDataFrame(alarms, "device_id string, boot_id string, alarm_key string, ts_us long, window_length_ms long, when_rtc_us long, max_when_us long, late_us long"),
        spark.createDataFrame(temps, "device_id string, boot_id string, ts_us long, temp int"))


def test_slices_give_what_arrays_give(spark, alarmed):
    """The algorithms' forms in numpy and as columns, and the summaries, over the same closed alarms."""
    alarms, temps = alarmed
    near = {"start_tolerance_us": 10**12, "trigger_tolerance_us": 10**12}
    named = G.registry() | {"steepest-fall": G.steepest_fall()}
    plain = {name: (lambda build: lambda: build())(build) for name, build in named.items() if name != "steepest-fall"}  # without pick
    whole = temps.where("temp is not null")
    got = {(r.alarm_key, r.algorithm): r.temp for r in A.evaluate_algorithms(alarms, whole, min_readings=3, algorithms=named, **near).collect()}
    want = {(r.alarm_key, r.algorithm): r.temp for r in A.evaluate_algorithms(alarms, whole, min_readings=3, algorithms=plain, **near).collect()}
    assert want and {k: v for k, v in got.items() if k[1] != "steepest-fall"} == want and len(got) == len(want) // 5 * 6
    rows = {r.alarm_key: r for r in A.alarm_temps(alarms, temps, **near).collect()}
    held = {(b, r.ts_us, r.temp) for b in "ab" for r in temps.where(F.col("boot_id") == b).collect()}
    for r in rows.values():
        inside = sorted(((t, x) for b, t, x in held if b == r.boot_id and r.start_ts <= t < min(r.max_when_us, r.close_us + 1)), key=str)
        assert sorted({(x.ts_us, x.temp) for x in r.readings}, key=str) == inside and [x.ts_us for x in r.readings] == sorted(x.ts_us for x in r.readings)
    known = {k: [x.temp for x in r.readings if x.temp is not None] for k, r in rows.items()}
    assert {r.alarm_key: (r.readings, r.min_temp) for r in A.alarm_summary(alarms, temps, **near).collect()} == {k: (len(r.readings), min(known[k], default=None)) for k, r in rows.items()}
    percents = {}
    for k, r in rows.items():
        for x in r.readings:
            if x.ts_us >= r.when_rtc_us:
                percents.setdefault((k, (x.ts_us - r.when_rtc_us) * 100 // (r.window_length_ms * 1000)), []).append(x.temp)
    got = {(r.alarm_key, r.percent): (r.n, r.min_temp) for r in A.alarm_percents(alarms, temps, **near).collect()}
    assert got == {k: (len(v), min((t for t in v if t is not None), default=None)) for k, v in percents.items()}


def test_readings_of_streamed_alarms_come_in_parts(monkeypatch):
    """Alarms that share their readings: lists are made when they are given, and not all at once; sums make none."""
    monkeypatch.setattr(T, "ROWS", 50)
    times, temps = list(range(100)), [20 + k % 7 for k in range(100)]
    out = [(str(k), 1, 99, 0, 20, slice(k, 90)) for k in range(20)]
    lists, sums = T.Closing(9, 9, 9, 9, 9), T.Summing(9, 9, 9, 9, 9)
    parts = list(lists._frames(("d", "b"), lists._with_readings(out, times, temps)))
    assert [len(p) for p in parts] == [1] * 20 + [0] and [t for p in parts for t in p.temps] == [temps[k:90] for k in range(20)]
    (summed,) = [p for p in sums._frames(("d", "b"), sums._with_readings(out, times, temps)) if len(p)]
    assert list(summed.readings) == [90 - k for k in range(20)] and set(summed.min_temp) == {20} and set(summed.last_temp) == {temps[89]}


def test_streamed_histograms_come_in_parts(monkeypatch):
    monkeypatch.setattr(T, "ROWS", 40)
    rng, trailing = random.Random(3), T.Trailing(25, 9)
    readings = sorted((rng.randint(0, 60), rng.randint(20, 30)) for _ in range(90))
    parts = list(trailing._frames(("d", "b"), trailing._histograms(readings, 10, list(range(80)), 0)))
    assert len(parts) > 10 and max(map(len, parts)) < 40 + 11
    got = {(r.line_id, r.temp): (r.ts_us, r.n, r.is_full) for p in parts for r in p.itertuples()}
    want = {}
    for line, (at, _) in enumerate(readings[10:]):
        for k, (t, temp) in enumerate(readings):
            if at - 25 <= t <= at:
                want[line, temp] = (at, want.get((line, temp), (0, 0))[1] + 1, at > 25)
    assert got == want
