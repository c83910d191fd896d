import time
import uuid

import pytest
from pyspark.sql import functions as F

from devicelogs import queries as q
from devicelogs.plans import ambient, daily, quality
from devicelogs.operators import timeops
from devicelogs.sources.adapter import read_events
from devicelogs.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """The log as six files in time order, to be fed one by one."""
    root = str(tmp_path_factory.mktemp("stream") / "log")
    log = q.states(read_events(spark, SF)).withColumn("line", F.concat_ws(" ", "device_id", "token"))
    for part in range(6):  # files are taken in the order of their writing
        log.where((F.dayofmonth("ts") - 1 >= 5 * part) & (F.dayofmonth("ts") - 1 < 5 * part + 5)).coalesce(1).write.mode("append").parquet(root)
        time.sleep(0.05)
    return root


def stream(spark, files):
    return spark.readStream.schema(spark.read.parquet(files).schema).option("maxFilesPerTrigger", 1).parquet(files)


def run(df, mode="append"):
    name = "t" + uuid.uuid4().hex
    df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_daily_jobs_equal_batch_for_closed_days(spark, files):
    log = spark.read.parquet(files)
    got = rows(run(jobs.daily_histogram(stream(spark, files))), "device_id", "day", "temp", "n")
    want = rows(daily.temperature_histogram(log), "device_id", "day", "temp", "n")
    assert set(got) <= set(want) and {x[1] for x in want} - {x[1] for x in got} <= {max(x[1] for x in want)}
    got = rows(run(jobs.alarms_per_device_day(stream(spark, files), F.col("tag") == "click")), "device_id", "day", "num_alarms")
    want = rows(daily.alarms_per_device_day(log, F.col("tag") == "click"), "device_id", "day", "num_alarms")
    assert set(got) <= set(want) and len(got) > 0.8 * len(want)


def test_keyed_state_equals_batch(spark, files):
    log = spark.read.parquet(files)
    got = rows(run(jobs.sleep_durations(stream(spark, files))), "line_id", "sleep_ns")
    want = rows(daily.sleep_durations(log).fillna(-1), "line_id", "sleep_ns")
    assert got == want and got
    got = rows(run(jobs.ambient_from_suspend(stream(spark, files))), "device_id", "boot_id", "ts_us", "ambient_temp")
    assert got == rows(ambient.ambient_from_suspend(log), "device_id", "boot_id", "ts_us", "ambient_temp") and got
    got = rows(run(jobs.gap_events(stream(spark, files))), "line_id", "token")
    assert got == rows(timeops.flag_gaps(log).where("gap"), "line_id", "token")


def test_dedup_and_trailing(spark, files):
    log = spark.read.parquet(files)
    twice = stream(spark, files).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    assert run(jobs.dedup_lines(twice)).count() == log.count() == quality.stitch(log).count()
    trailing = run(jobs.trailing_distribution(stream(spark, files), slide="12 hours"))
    assert trailing.count() > 0


def test_stream_join_and_sessions(spark, files):
    log = spark.read.parquet(files)
    click = F.col("tag") == "click"
    cols = lambda d: d.where(click).select("device_id", "boot_id", F.col("event_id").alias("alarm_key"), F.col("ts").alias("alarm_ts"), F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("interval 6 hours")).alias("end_ts"))
    got = rows(run(jobs.readings_of_alarms(cols(stream(spark, files)), stream(spark, files))), "alarm_key", "ts")
    want = rows(cols(log).join(log.select("device_id", "boot_id", "ts"), ["device_id", "boot_id"]).where("ts >= start_ts and ts < end_ts"), "alarm_key", "ts")
    assert got == want and got
    sessions = run(jobs.pending_sessions(stream(spark, files), max_session="48 hours")).collect()
    assert sessions and all(0 <= r.sleep_us - r.wake_us <= 48 * 3600 * 10**6 for r in sessions)
