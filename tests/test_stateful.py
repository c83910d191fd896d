"""Keyed state behind the watermark: order, late rows, idle boots and restarts."""

import uuid

import pytest
from pyspark.sql import functions as F

from devicelogs.operators import distribution, timeops
from devicelogs.plans import ambient, daily
from devicelogs.streaming import stateful

HOUR = 3_600_000_000
SCHEMA = "device_id string, boot_id string, ts timestamp, ts_us long, token long, line_id long, pm string, temp int"


def table(spark, rows):
    """Rows (boot, seconds, token, pm, temp) of one device."""
    made = [("d", b, s * 1_000_000, t, t, pm, temp) for b, s, t, pm, temp in rows]
    return spark.createDataFrame(made, "device_id string, boot_id string, ts_us long, token long, line_id long, pm string, temp int").withColumn("ts", F.timestamp_micros("ts_us")).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def feed(spark, root, rows):
    table(spark, rows).coalesce(1).write.mode("append").parquet(f"{root}/in")


def run(spark, root, job):
    """Takes what is new in root and gives all that the job has given so far; a rerun goes on from the checkpoint."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    with stateful.start_with_rocksdb(spark):
        query = job(stream).writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None
    return spark.read.parquet(f"{root}/out"), query


def got(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def test_late_and_shuffled_rows(spark, root):
    job = lambda s: stateful.gap_events(s, "10 minutes")
    feed(spark, root, [("b", 100, 3, None, 1), ("b", 40, 1, None, 1)])
    feed(spark, root, [("b", 60, 2, None, 1), ("b", 900, 7, None, 1)])  # token 2 comes late but within the watermark: no gap at 3
    feed(spark, root, [("b", 1000, 8, None, 1), ("b", 2000, 9, None, 1)])
    feed(spark, root, [("b", 50, 99, None, 1), ("b", 9000, 12, None, 1)])  # token 99 is behind the watermark
    feed(spark, root, [("x", 90_000, 1, None, 1)])  # moves the watermark on
    found, _ = run(spark, root, job)
    assert got(found, "line_id", "token") == [(7, 7), (12, 12)]


def test_restart_gives_the_same_rows(spark, tmp_path):
    rows = [("b", 1000 + 600 * k, k + (k > 20) + 2 * (k > 33), [None, "entry", None, "exit"][k % 4], 30 + k % 9) for k in range(60)] + [("end", 10**6, 1, None, 1)]
    parts = [sorted(rows[k : k + 16], key=lambda r: -r[1]) for k in range(0, len(rows), 16)]
    jobs = {"gap": stateful.gap_events, "sleep": stateful.sleep_durations, "ambient": lambda s: stateful.ambient_from_suspend(s, 600_000_000), "trailing": lambda s: stateful.trailing_at_readings(s, 2 * HOUR)}
    batch = table(spark, rows).where("boot_id = 'b'")
    for name, job in jobs.items():
        once, again = str(tmp_path / f"{name}1"), str(tmp_path / f"{name}2")
        for part in parts:
            feed(spark, once, part)
        whole = run(spark, once, job)[0]
        for k, part in enumerate(parts):
            feed(spark, again, part)
            if k in (1, len(parts) - 1):
                stepped = run(spark, again, job)[0]  # stops and starts anew
        keys = sorted(set(whole.columns) - {"device_id"})
        assert got(whole, *keys) == got(stepped, *keys) and whole.count()
        if name == "gap":
            assert got(whole, "line_id") == got(timeops.flag_gaps(batch).where("gap"), "line_id")
        elif name == "sleep":
            assert got(whole, "line_id", "sleep_ns") == got(daily.sleep_durations(batch).fillna(-1), "line_id", "sleep_ns")
        elif name == "ambient":
            assert got(whole, "ts_us", "ambient_temp") == got(ambient.ambient_from_suspend(batch, 600_000_000), "ts_us", "ambient_temp")
        else:
            probes = batch.select("device_id", "boot_id", F.col("line_id").alias("probe_id"), F.col("ts_us").alias("at_us"))
            want = distribution.trailing_histogram(probes, batch, 2 * HOUR)
            assert got(whole.where("boot_id = 'b'"), "line_id", "temp", "n") == got(want, "probe_id", "temp", "n")


def test_state_goes_after_the_idle_time(spark, root):
    job = lambda s: stateful.sleep_durations(s, "1 minute", "1 hour")
    feed(spark, root, [("b", 10, 1, "entry", None), ("c", 20, 1, "entry", None)])
    feed(spark, root, [("x", 3000, 1, "entry", None)])
    feed(spark, root, [("c", 3010, 2, "exit", None), ("x", 4000, 2, "entry", None)])  # c comes back in time
    feed(spark, root, [("x", 9000, 3, "entry", None)])  # b and c have been idle for an hour
    feed(spark, root, [("b", 9100, 2, "exit", None), ("x", 99_000, 4, "entry", None)])
    found, query = run(spark, root, job)
    assert got(found, "boot_id", "line_id", "sleep_ns") == [("b", 2, -1), ("c", 2, 2990 * 10**9)]
    states = query.lastProgress["stateOperators"][0]
    assert states["numRowsTotal"] <= 12  # of x alone, and not of three boots


def test_alarms_of_a_stream(spark, root):
    """Each file is an hour of readings with an alarm; the stream stops and goes on, and gives what the batch plan gives."""
    from devicelogs.plans import alarms as plans

    def log(rows):
        return spark.createDataFrame(rows, "device_id string, boot_id string, ts_us long, temp int, alarm_key string, when_rtc_us long, max_when_us long, late_us long, window_length_ms long").withColumn("ts", F.timestamp_micros("ts_us"))

    def job(stream):
        return stateful.alarm_temps(stream.where("alarm_key is not null"), stream.where("temp is not null"), 70_000_000, 100_000_000, 2 * HOUR, 3 * HOUR, "10 minutes", "9 hours")

    minute, rows = 60_000_000, []
    for k in range(400):
        if not 150 <= k < 170:  # a hole
            rows.append(("d", "b", k * minute + 7, 20 + k * 7 % 31, None, None, None, None, None))
        if k % 9 == 4:
            late = (k % 5) * 5 * minute
            when = k * minute - late + 11_000_000
            rows.append(("d", "b", k * minute + 11_000_000, None, f"a{k:03}", when, when + (k % 4) * 20 * minute, late, (k % 4) * 1_200_000))
    parts = [rows[k : k + 90][::-1] for k in range(0, len(rows), 90)]
    schema = log(rows[:1]).schema
    for k, part in enumerate([*parts, [("d", "x", 10**12, 1, None, None, None, None, None)]]):
        log(part).coalesce(1).write.mode("append").parquet(f"{root}/in")
        if k in (1, len(parts)):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
            with stateful.start_with_rocksdb(spark):
                job(stream).writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination()
    whole = spark.read.parquet(f"{root}/out").collect()
    batch = log(rows)
    alarms, temps = batch.where("alarm_key is not null").drop("temp"), batch.where("temp is not null").select("device_id", "boot_id", "ts_us", "temp")
    want = plans.alarm_temps(alarms, temps, start_tolerance_us=70_000_000, trigger_tolerance_us=100_000_000, period_us=2 * HOUR).collect()
    key = lambda r: (r.alarm_key, r.window_length_ms, r.close_us, r.start_ts, r.trigger_temp, [tuple(x) for x in r.readings])
    assert sorted(key(r) for r in whole if r.readings) == sorted(map(key, want)) and len(want) > 10
    never = {r.alarm_key for r in whole if r.close_us is None}
    assert never == {r[4] for r in rows if r[4] and r[8] and max(r[2], r[6]) >= 399 * minute + 7} and never
    assert len({r.alarm_key for r in whole}) == len(whole)
