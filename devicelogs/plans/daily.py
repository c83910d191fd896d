"""Daily roll-ups and sleep durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.distribution import PERIOD_US, trailing_percentile
from ..operators.states import day_key
from ..operators.timeops import KEYS, last, running


def temperature_histogram(temps: DataFrame) -> DataFrame:
    """Readings by device, day and temperature."""
    return temps.groupBy("device_id", day_key().alias("day"), "temp").agg(F.count("*").alias("n"))


def alarms_per_device_day(log: DataFrame, is_alarm: Column) -> DataFrame:
    """Delivered alarms by device and day; days with lines but no alarm give 0."""
    return log.groupBy("device_id", day_key().alias("day")).agg(F.count_if(is_alarm).alias("num_alarms"))


def alarm_window_lengths(alarms: DataFrame, uuid: str = "uuid", boot_ids: list[str] | None = None, keys=KEYS) -> DataFrame:
    """The window length of each alarm's first line in a boot, without those of 0."""
    kept = alarms.where("window_length_ms <> 0")
    if boot_ids:
        kept = kept.where(F.col("boot_id").isin(boot_ids))
    return kept.groupBy(*keys, uuid).agg(F.min_by("window_length_ms", F.struct("token", "trace_time")).alias("window_length_ms"))


def sleep_durations(events: DataFrame, keys=KEYS, slices: Column | None = None) -> DataFrame:
    """Per suspend exit: nanoseconds since the latest entry, null without one. An entry serves several exits."""
    entry = F.when(F.col("pm") == "entry", F.col("ts_us"))
    seen = running(events.where("pm is not null"), {"_entry": last(entry)}, keys, slices=slices)
    return seen.where("pm = 'exit'").withColumn("sleep_ns", (F.col("ts_us") - F.col("_entry")) * 1000).drop("_entry")


def day_probes(temps: DataFrame, keys=KEYS) -> DataFrame:
    """Per day that another day of the stream follows: the last reading before the next day's first line."""
    days = temps.groupBy(*keys, day_key().alias("day")).agg(F.max("ts_us").alias("at_us"))
    latest = days.groupBy(*keys).agg(F.max("day").alias("_latest"))
    return days.join(latest, [*keys]).where(F.col("day") < F.col("_latest")).select(*keys, F.col("day").alias("probe_id"), "at_us")


def ambient_from_distribution(temps: DataFrame, percentiles=range(6), period_us: int = PERIOD_US, keys=KEYS) -> DataFrame:
    """Per stream and closed day: the lowest percentiles of the trailing period that ends with the day's last reading."""
    found = trailing_percentile(day_probes(temps, keys), temps, list(percentiles), period_us, keys=keys)
    return found.withColumnRenamed("probe_id", "day").withColumnRenamed("percentile_temp", "ambient_temp")


def ambient_collected(ambient: DataFrame) -> DataFrame:
    """Per device and day the list of values, sorted."""
    return ambient.groupBy("device_id", "day").agg(F.sort_array(F.collect_list("ambient_temp")).alias("temps"))


