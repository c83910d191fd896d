"""The driver's tables as device logs: every event is a line, a reading and a state event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timeops import running, total


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """device_id, boot_id, token, trace_time, ts, ts_us, tag, temp, k, event_id: ~20 devices, three boots each, tokens with sparse gaps."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    device = (F.col("user_id") % 20).cast("string")
    boot = F.concat(device, F.lit("-"), F.floor((F.dayofmonth("ts") - 1) / 10).cast("string"))
    rows = e.select(
        "event_id", device.alias("device_id"), boot.alias("boot_id"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("event_type").alias("tag"),
        F.floor("value").cast("int").alias("temp"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    step = F.lit(1) + F.when(F.col("event_id") % 37 == 0, 1).otherwise(0)
    numbered = running(rows, {"token": total(step)}, order=("ts_us", "event_id"))
    return numbered.withColumns({"trace_time": F.col("ts_us") / 1e6, "line_id": F.col("event_id")})


def read_ctx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-switch rows from lineitem: device_id, boot_id, cpu, pid, comm, rtime, bg_rtime, ts_us, line_id and is_end."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_shipdate")
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return li.select(
        (F.col("l_suppkey") % 20).cast("string").alias("device_id"), F.year("l_shipdate").cast("string").alias("boot_id"), (F.col("l_linenumber") % 4).alias("cpu"),
        F.col("l_partkey").alias("pid"), F.when(F.col("l_partkey") % 5 == 0, F.lit("swapper/0")).otherwise(F.lit("app")).alias("comm"), F.col("l_quantity").cast("long").alias("rtime"),
        F.floor(F.col("l_quantity") * F.col("l_discount")).cast("long").alias("bg_rtime"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ts_us"), line.alias("line_id"),
        F.when(line % 11 == 0, "begin").when(line % 7 == 0, "end").otherwise("info").alias("kind"))


def alarms_of(log: DataFrame, hour_ms: int = 3_600_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """click: a delivered alarm with window_length_ms, when_rtc_us, max_when_us, elapsed_us and app_pid."""
    window_us = (F.col("k") + 1) * F.lit(hour_ms).cast("long") * 1000
    return log.where("tag = 'click'").select(
        "device_id", "boot_id", "token", "trace_time", "line_id", "ts_us", F.md5(F.col("line_id").cast("string")).alias("alarm_key"), ((F.col("k") + 1) * hour_ms).cast("long").alias("window_length_ms"),
        F.col("ts_us").alias("when_rtc_us"), (F.col("ts_us") + window_us).alias("max_when_us"), (window_us / 2).cast("long").alias("late_us"), (F.col("k") % 10).alias("app_pid"), *keep)
