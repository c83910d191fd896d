import bisect
import random
import time
from collections import Counter
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from devicelogs import queries as q
from devicelogs.functions import algorithms
from devicelogs.operators import distribution as D
from devicelogs.operators import states as S
from devicelogs.operators import timeops as O
from devicelogs.plans import alarms as A
from devicelogs.plans import ambient as M
from devicelogs.plans import quality as Q
from devicelogs.plans import sessions as W
from devicelogs.sources import logs
from devicelogs.sources.adapter import read_events

SF = "/root/testdata/sf0.001"
READING = "device_id string, boot_id string, ts_us long, temp int"


def us(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp() * 1e6 + 0.5)


def readings(spark, pairs):
    return spark.createDataFrame([("d", "b", int(t), v) for t, v in pairs], READING)


def test_nearest_rank(spark):
    # The readings and their percentiles.
    temps = [43, 54, 56, 61, 62, 66, 68, 69, 69, 70, 71, 72, 77, 78, 79, 85, 87, 88, 89, 93, 95, 96, 98, 99, 99]
    h = readings(spark, enumerate(temps)).groupBy("device_id", "temp").agg(F.count("*").alias("n"))
    got = {r.p: r.percentile_temp for r in D.nearest_rank(h, [0, 1, 50, 90, 100], ["device_id"]).collect()}
    assert got == {0: 43, 1: 43, 50: 77, 90: 98, 100: 99}
    (r,) = A.percentile_array(h, ["device_id"]).collect()
    assert [r.percentiles[p] for p in (0, 1, 50, 90, 100)] == [43, 43, 77, 98, 99]


# Probes and the readings that must be found.
NEAREST = [
    ("2017-02-06 13:51:03.849685", "2017-02-06 13:50:15.101710"), ("2017-02-06 14:38:03.849685", "2017-02-06 13:50:15.101710"), ("2017-02-06 15:38:03.849684", "2017-02-06 16:38:03.849685"),
    ("2017-02-06 16:38:03.849686", "2017-02-06 16:38:03.849685"), ("2017-02-06 20:49:13.296307", "2017-02-06 20:49:13.296306"), ("2017-02-06 20:49:13.496307", "2017-02-06 20:49:13.496306"),
    ("2017-02-06 20:49:13.496306", "2017-02-06 20:49:13.496306"), ("2017-02-07 15:02:35.987999", "2017-02-07 15:02:35.987999"), ("2017-02-07 15:02:35.988000", "2017-02-07 15:02:35.987999"),
]


def test_nearest_goldens(spark):
    answers = sorted({us(b) for _, b in NEAREST})
    probes = readings(spark, [(us(a), i) for i, (a, _) in enumerate(NEAREST)])
    got = {r.temp: r.near_ts for r in O.asof_nearest(probes, readings(spark, [(t, 1) for t in answers]), 10**12).collect()}
    assert got == {i: us(b) for i, (_, b) in enumerate(NEAREST)}


def test_nearest_tolerance_of_the_known_case(spark):
    probe = readings(spark, [(1488392689937000, 0)])
    at = readings(spark, [(us("2017-03-01 18:25:01.891465"), 40)])
    assert [r.near_value for r in O.asof_nearest(probe, at, 10_000_000).collect()] == [None]
    assert [r.near_value for r in O.asof_nearest(probe, at, 12_000_000).collect()] == [40]


@pytest.mark.parametrize("slices", [None, 50])
def test_nearest_against_brute_force(spark, slices):
    rng = random.Random(5)
    times = sorted(rng.sample(range(1000), 80))
    probes = rng.sample(range(-50, 1100), 120)
    cut = None if slices is None else F.floor(F.col("_t") / 50)
    rows = O.asof_nearest(readings(spark, [(p, 0) for p in probes]), readings(spark, [(t, t % 90) for t in times]), 20, slices=cut).collect()
    assert len(rows) == len(probes)
    for r in rows:
        want = min(times, key=lambda t: (abs(t - r.ts_us), t))
        assert r.near_ts == want and r.near_value == (want % 90 if abs(want - r.ts_us) <= 20 else None)


def test_slices_change_nothing(spark):
    log = q.states(read_events(spark, SF))
    cut = O.token_slice(7)
    pick = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    assert pick(O.gap_epochs(log), "event_id", "gap_epoch") == pick(O.gap_epochs(log, slices=cut), "event_id", "gap_epoch")
    assert pick(S.charge_state(log), "event_id", "charge_state", "changed") == pick(S.charge_state(log, slices=cut), "event_id", "charge_state", "changed")
    ahead = {"x": O.following(F.col("screen")), "y": O.lag(F.col("temp")), "z": O.total(F.col("k"), False)}
    assert pick(O.running(log, ahead), "event_id", "x", "y", "z") == pick(O.running(log, ahead, slices=cut), "event_id", "x", "y", "z")


def test_missing_lines_cover_the_range(spark):
    tokens = sorted(random.Random(3).sample(range(5, 400), 150))
    log = spark.createDataFrame([("d", "b", t) for t in [*tokens, *tokens[:9]]], "device_id string, boot_id string, token long")
    missing = {t for r in Q.missing_loglines(log).collect() for t in range(r.start, r.end + 1)}
    assert missing | set(tokens) == set(range(tokens[0], tokens[-1] + 1)) and not missing & set(tokens)


def test_stitch_is_idempotent_and_ordered(spark):
    log = spark.createDataFrame([("d", "b", t, t / 2, f"line {t}") for t in [5, 3, 3, 9, 1, 5]], "device_id string, boot_id string, token long, trace_time double, line string")
    once = Q.stitch(log)
    assert [r.token for r in once.collect()] == [1, 3, 5, 9]
    assert Q.stitch(once.drop("line_md5", "part")).count() == 4


def algorithm_rows(spark, base):
    """Temperature i at second i, a window of 10 s from second 60."""
    row = [(60_000_000, 10_000_000, 80, [(i * 1_000_000, i) for i in range(60, 100)], list(range(0, 101)))]
    df = spark.createDataFrame(row, "when_rtc_us long, window_us long, trigger_temp int, readings array<struct<ts_us:long,temp:int>>, percentiles array<int>")
    temps = readings(spark, [(i * 1_000_000, i) for i in range(100)])
    table = A.percentile_array(temps.groupBy("temp").agg(F.count("*").alias("n")).withColumn("g", F.lit(1)), ["g"]).first().percentiles
    return df.withColumn("percentiles", F.array(*[F.lit(p) for p in table]))


def test_linear_threshold(spark):
    df = algorithm_rows(spark, 25)
    assert df.select(algorithms.linear_threshold(25)()).first()[0] == 66
    with pytest.raises(ValueError):
        algorithms.linear_threshold(0)


def test_stopping_rules_against_python(spark):
    import math

    rng = random.Random(9)
    rows = []
    for _ in range(30):
        n = rng.randint(1, 40)
        rows.append((1000, 1000, rng.randint(20, 60), [(1000 + 25 * i, rng.randint(20, 60)) for i in range(n)], list(range(101))))
    df = spark.createDataFrame(rows, "when_rtc_us long, window_us long, trigger_temp int, readings array<struct<ts_us:long,temp:int>>, percentiles array<int>")
    got = df.select("readings", "trigger_temp", algorithms.stopping()().alias("os"), algorithms.cardinal_stopping()().alias("oc"), algorithms.oracle().alias("oracle"), algorithms.android().alias("android")).collect()

    def stop(readings, limit):
        best, pct = 100_000, lambda t: (t - 1000) * 100 / 1000
        for t, v in readings:
            if pct(t) < limit:
                best = min(best, v)
        return next((v for t, v in readings if pct(t) >= limit and v < best), readings[-1][1])

    for r in got:
        assert r.os == stop(r.readings, 100 / math.e) and r.oc == stop(r.readings, math.ceil(math.sqrt(len(r.readings))))
        assert r.oracle == min([r.trigger_temp, *[x.temp for x in r.readings]]) and r.android == r.trigger_temp


def test_ctx_periods_against_a_state_machine(spark):
    rng = random.Random(4)
    rows = [("d", "b", i % 2, i, i, rng.choice(["begin", "info", "info", "end"]), rng.randint(0, 9), 0, rng.choice(["app", "swapper/0"])) for i in range(400)]
    df = spark.createDataFrame(rows, "device_id string, boot_id string, cpu int, ts_us long, line_id long, kind string, rtime long, bg_rtime long, comm string")
    want = []
    for cpu in (0, 1):
        held = None
        for r in rows:
            if r[2] != cpu:
                continue
            if r[5] == "begin" and held is None:
                held = []
            elif r[5] == "info" and held is not None:
                held.append(r[4])
            elif r[5] == "end" and held is not None:
                want += held
                held = None
    periods = S.ctx_periods(df)
    assert sorted(r.line_id for r in periods.collect()) == sorted(want)
    assert all(0 <= r.busyness <= 1 for r in S.busyness(periods).collect())


def test_fgbg_counts(spark):
    """16 lines: 6 before any event, 7 in the foreground or its delay, 3 after the delay."""
    pids = [None] * 6 + [42, None, None, 7, None, 0, None] + [None] * 3
    times = [0.1 * i for i in range(13)] + [2.3, 2.4, 2.5]
    rows = [("d", "b", i, t, i, p) for i, (t, p) in enumerate(zip(times, pids, strict=True))]
    log = spark.createDataFrame(rows, "device_id string, boot_id string, token long, trace_time double, line_id long, fg_pid long")
    counts = {r.fgbg_state: r["count"] for r in S.fgbg_state(log).groupBy("fgbg_state").count().collect()}
    assert counts == {"unknown": 6, "foreground": 7, "background": 3}


def test_last_event_and_predicates(spark):
    rows = [("d", "b", 1, 1.0, 1, 0, 1, 300, None, None), ("d", "b", 2, 2.0, 2, 0, 2, None, "offline", 0), ("d", "b", 3, 3.0, 3, 0, 3, 600, None, None)]
    df = spark.createDataFrame(rows, "device_id string, boot_id string, token long, trace_time double, line_id long, cpu int, ts_us long, freq int, hotplug string, error int")
    assert [r.last_event_line for r in S.cpu_last_event(df).orderBy("token").collect()] == [1, 2, 3]
    assert S.apply_predicates(df, F.col("freq") > 100, F.col("token") > 1).count() == 1


def test_ambient_from_suspend_against_a_state_machine(spark):
    log = q.states(read_events(spark, SF))
    rows = sorted(log.collect(), key=lambda r: (r.device_id, r.boot_id, r.token))
    want, stream = [], None
    for r in rows:
        if (r.device_id, r.boot_id) != stream:
            stream, entry, left, before, temp, waiting = (r.device_id, r.boot_id), None, None, 0, 0, False
        if r.pm == "entry":
            if not (left is not None and before != 0 and temp <= before):
                entry, before = r.ts_us, temp
                if left is not None:
                    waiting = False
        elif r.pm == "exit":
            left = r.ts_us
            if entry is not None and left - entry > 1200_000_000:
                waiting = True
        else:
            temp = r.temp
            if waiting and temp <= 35:
                want.append((r.device_id, r.boot_id, r.ts_us, temp))
                waiting, entry, left = False, None, None
    got = [(r.device_id, r.boot_id, r.ts_us, r.ambient_temp) for r in M.ambient_from_suspend(log).collect()]
    assert sorted(got) == sorted(want) and got


def test_ambient_options(spark):
    minute = 60_000_000
    rows = [(0, None, 30, "unplugged"), (1, "entry", None, None), (30, "exit", None, None), (33, "entry", None, None), (60, "exit", None, None), (61, None, 25, None)]
    log = spark.createDataFrame([("d", "b", i + 1, float(i), i, m * minute, pm, t, c) for i, (m, pm, t, c) in enumerate(rows)], "device_id string, boot_id string, token long, trace_time double, line_id long, ts_us long, pm string, temp int, charge string")
    found = lambda df, **more: [(r.ts_us // minute, r.ambient_temp) for r in M.ambient_from_suspend(df, **more).collect()]
    assert found(log) == [(61, 25)] == found(log, require_unplugged=True)
    assert found(log, least_sleep_us=40 * minute) == [(61, 25)]  # from the first entry on
    assert found(log, least_sleep_us=40 * minute, least_awake_us=minute) == []
    assert found(log.withColumn("charge", F.lit("charging")), require_unplugged=True) == []


LOCKS = "device_id string, boot_id string, token long, trace_time double, line_id long, ts_us long, screen string, charge string, what string, pid long, lock long, alarm_key string"


def lock_log(spark, *events):
    """Events (second, what, pid, lock or alarm key) after the screen went off and the charger."""
    rows = [("d", "b", 1, 0.0, 0, 0, "off", None, None, None, None, None), ("d", "b", 2, 0.0, 1, 0, None, "unplugged", None, None, None, None)]
    for i, (t, what, pid, which) in enumerate(events, 3):
        state = {"on": ("on", None), "charging": (None, "charging")}.get(what, (None, None))
        rows.append(("d", "b", i, float(t), i, t * 1_000_000, *state, what if what in ("alarm", "acquire", "release") else None, pid, which if what != "alarm" else None, which if what == "alarm" else None))
    return spark.createDataFrame(rows, LOCKS)


def holds(spark, *events):
    return sorted((r.alarm_key, r.pid, r.acquire_us // 1_000_000, r.release_us // 1_000_000) for r in M.wakelock_holds(lock_log(spark, *events)).collect())


def test_wakelock_holds(spark):
    one = [(1, "alarm", 7, "k1"), (2, "acquire", 7, 1), (3, "acquire", 7, 2), (4, "release", 7, 1), (5, "release", 7, 2)]
    assert holds(spark, *one, (20, None, None, None)) == [("k1", 7, 2, 5)]
    assert holds(spark, *one, (15, None, None, None)) == []  # the tail has not passed
    assert holds(spark, *one, (9, "on", None, None), (20, None, None, None)) == [] == holds(spark, *one, (9, "charging", None, None), (20, None, None, None))
    assert holds(spark, *one[:4], (5, "release", 9, 2), (20, None, None, None)) == [("k1", 7, 2, 5)]  # released by another process
    again = [*one, (8, "acquire", 7, 3), (9, "release", 7, 3), (30, None, None, None)]
    assert holds(spark, *again) == [("k1", 7, 2, 5)]  # the second hold finds no alarm any more
    assert holds(spark, (0, "alarm", 7, "k0"), *again) == [("k0", 7, 2, 5), ("k1", 7, 8, 9)]
    assert holds(spark, (1, "acquire", 7, 1), (2, "alarm", 7, "k"), (3, "release", 7, 1), (20, None, None, None)) == []
    assert holds(spark, (1, "alarm", 7, "k"), (2, "acquire", 8, 1), (3, "release", 8, 1), (20, None, None, None)) == []


def test_alarm_wakelock_cpu(spark):
    log = lock_log(spark, (1, "alarm", 7, "k1"), (2, "acquire", 7, 1), (6, "release", 7, 1), (30, None, None, None))
    found = M.wakelock_holds(log)
    kinds = [(2, "begin", 0, 0), (3, "info", 7, 1), (4, "info", 1, 7), (5, "info", 1, 1), (6, "end", 0, 0), (7, "begin", 0, 0), (8, "info", 7, 7), (9, "end", 0, 0), (17, "begin", 0, 0), (18, "info", 7, 7), (19, "end", 0, 0)]
    ctx = spark.createDataFrame([("d", "b", 0, pid, tgid, t * 1_000_000, t, kind, 10 * t, "x") for t, kind, pid, tgid in kinds], "device_id string, boot_id string, cpu int, pid int, tgid int, ts_us long, line_id long, kind string, rtime long, comm string")
    freq = lambda *at: spark.createDataFrame([("d", "b", t * 1_000_000, 0, f) for t, f in at], "device_id string, boot_id string, ts_us long, cpu int, freq int")
    temps = readings(spark, [(t * 1_000_000, t) for t in (1, 2, 5, 16, 17)])
    rows = M.alarm_wakelock_cpu(found, ctx, freq((1, 100), (5, 200), (8, 300)), temps).collect()
    assert sorted((r.line_id, r.period_total, round(r.share, 3), r.frequency, r.duration_us) for r in rows) == [(3, 120, 0.25, 200, 4_000_000), (4, 120, 0.333, 200, 4_000_000), (8, 80, 1.0, 300, 4_000_000)]
    assert rows[0].temps == [2, 5, 16]
    assert [r.line_id for r in M.alarm_wakelock_cpu(found, ctx, freq((1, 100), (8, 300))).collect()] == [8]  # unknown at the acquire
    assert M.mean_hold(found).first().mean_hold_s == 4.0


def test_long_streams_take_seconds(spark):
    n = 200_000
    began = time.time()
    log = spark.range(n).select(F.lit("d").alias("device_id"), F.lit("b").alias("boot_id"), (F.col("id") * 1_000_000).alias("ts_us"), (F.col("id") * 7919 % 60).cast("int").alias("temp"), F.lit("heating").alias("curve"), F.lit(20).alias("threshold_temp"))
    assert O.asof_nearest(log, log.where("ts_us % 7000000 = 0"), 3_000_000).where("near_value is null").count() == 0
    got = D.curve_probabilities(log, [60, 3600])
    assert {r.period_s: r.s for r in got.groupBy("period_s").agg(F.sum("seen").alias("s")).collect()} == {p: (p - 1) * n - (p - 1) * p // 2 for p in (60, 3600)}
    assert time.time() - began < 90


def test_curve_probabilities_in_slices(spark):
    rng = random.Random(8)
    rows = [("d", "b", rng.randint(0, 400) * 1_000_000, rng.randint(10, 60), "cooling", 30) for _ in range(150)]
    log = spark.createDataFrame(rows, "device_id string, boot_id string, ts_us long, temp int, curve string, threshold_temp int")
    want = {}
    for a in rows:
        for p in (30, 100):
            later = [b for b in rows if a[2] < b[2] < a[2] + p * 1_000_000]
            seen, below = want.get((a[3] - a[3] % 5, p), (0, 0))
            want[a[3] - a[3] % 5, p] = seen + len(later), below + sum(b[3] < 30 for b in later)
    for cut in (None, F.floor(F.col("_at") / 70_000_000)):
        got = {(r.temp_bucket, r.period_s): (r.seen, r.below) for r in D.curve_probabilities(log, [30, 100], slices=cut).collect()}
        assert got == {k: v for k, v in want.items() if v[0]}


def test_steps_keep_stitched_lines_single(spark, tmp_path):
    lines = lambda file, tokens: spark.createDataFrame([("d1", "b1", t, t / 2, f"line {t}", t, file) for t in tokens], "device_id string, boot_id string, token long, trace_time double, line string, ts_us long, file string")
    path = str(tmp_path / "log")
    parse = lambda df: df.drop("file")
    taken = logs.stitch_incrementally(lines("a", [1, 2, 3, 3]), None, path, parse)
    taken = O.written(taken)
    assert [r.file for r in logs.stitch_incrementally(lines("a", [1, 9]).unionByName(lines("b", [2, 3, 4, 4])), taken, path, parse).collect()] == ["b"]
    assert sorted(r.token for r in logs.read_loglines(spark, path).collect()) == [1, 2, 3, 4]


def test_wake_session_rules(spark):
    def session(*events):
        rows = [("d", "b", i + 1, float(i), i, m * 60_000_000, pm, screen, charge) for i, (m, pm, screen, charge) in enumerate(events)]
        df = spark.createDataFrame(rows, "device_id string, boot_id string, token long, trace_time double, line_id long, ts_us long, pm string, screen string, charge string")
        return [(r.wake_us // 60_000_000, r.sleep_us // 60_000_000) for r in W.wake_sessions(df).collect()]

    start = [(0, None, "off", None), (1, None, None, "unplugged")]
    assert session(*start, (2, "exit", None, None), (5, "entry", None, None)) == [(2, 5)]
    assert session(*start, (2, "exit", None, None), (3, None, "on", None), (5, "entry", None, None)) == []
    assert session(*start, (2, "exit", None, None), (3, None, None, "charging"), (5, "entry", None, None)) == []
    assert session(*start, (2, "exit", None, None), (125, "entry", None, None)) == []
    assert session((1, None, None, "unplugged"), (2, "exit", None, None), (5, "entry", None, None)) == []


def test_sources_round_trip(spark, tmp_path):
    import gzip

    (tmp_path / "raw/a").mkdir(parents=True)
    with gzip.open(tmp_path / "raw/a/1.out.gz", "wt") as f:
        f.write("d1\t1\t1.5\tb1\t2\t0.5\t2017-01-02 00:00:00.5 1 2 D T x\nd1\t1\t1.5\tb1\t1\t0.4\t2017-01-01 10:00:00.25 1 2 D T y\n" * 2)
    from devicelogs.functions.parse import parse_loglines

    raw = logs.read_raw(spark, str(tmp_path / "raw"))
    assert raw.count() == 4 and logs.read_raw(spark, str(tmp_path / "raw"), devices=["zz"]).count() == 0
    out = str(tmp_path / "stitched")
    taken = logs.stitch_incrementally(raw, None, out, parse_loglines)
    log = logs.read_loglines(spark, out, devices=["d1"], boot_ids=["b1"])
    assert log.count() == 2 and logs.in_daterange(log, "20170102-20170102").count() == 1
    assert logs.line_filter(log, simple=["x"], regex=["y$"]).count() == 2 and logs.line_filter(log, simple=["zz"]).count() == 0
    (m,) = logs.build_manifest(spark, out).collect()
    assert m.lines == 2 and m.end_ns > m.start_ns
    assert logs.new_files(raw, taken).count() == 0
    logs.write_result(log.groupBy("device_id").count(), str(tmp_path), "counts")
    assert spark.read.json(f"{tmp_path}/analysis/counts").count() == 1


def test_curve_grid(spark):
    assert D.curve_grid(spark, [60, 600]).count() == 3 * 24 * 2


def test_idx_and_bisect(spark):
    times = sorted(random.Random(2).sample(range(10_000), 60))
    df = readings(spark, [(t, 1) for t in times])
    assert D.idx_for_duration(df, 4000).first().idx == bisect.bisect_left(times, times[0] + 4000)
    assert D.idx_for_duration(df, 20_000).first().idx == -1


@pytest.mark.parametrize("period", [1, 40, 24 * 7, D.PERIOD_US // 1000])
def test_trailing_histogram_is_what_the_window_holds(spark, period):
    rng = random.Random(period)
    span = 4 * period + 30
    temps = [(str(k % 2), "b", rng.randint(-span, span), rng.randint(20, 26)) for k in range(150)]
    probes = [(str(k % 3), "b", k, rng.randint(-2 * span, 2 * span)) for k in range(40)] + [(d, b, 100 + k, t) for k, (d, b, t, _) in enumerate(temps[:40])]
    readings = spark.createDataFrame(temps, "device_id string, boot_id string, ts_us long, temp int")
    got = D.trailing_histogram(spark.createDataFrame(probes, "device_id string, boot_id string, probe_id long, at_us long"), readings, period)
    want = Counter((p, t) for d, _, p, at in probes for e, _, ts, t in temps if d == e and at - period <= ts <= at)
    assert {(r.probe_id, r.temp): r.n for r in got.collect()} == want


def test_nearest_rank_against_its_definition(spark):
    rng = random.Random(3)
    groups = {g: sorted(rng.randint(0, 30) for _ in range(rng.choice([1, 2, 7, 100, 333]))) for g in range(30)}
    histogram = spark.createDataFrame([(g, t, n) for g, ts in groups.items() for t, n in Counter(ts).items()], "g int, temp int, n long")
    for percentiles in (list(range(101)), [0, 1, 50, 99, 100], [33]):
        got = {(r.g, r.p): r.percentile_temp for r in D.nearest_rank(histogram, percentiles, ["g"]).collect()}
        assert got == {(g, p): ts[max(-(-len(ts) * p // 100), 1) - 1] for g, ts in groups.items() for p in percentiles}
