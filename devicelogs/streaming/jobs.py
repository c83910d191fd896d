"""Streaming jobs. Event time is ts; most take a watermark, the lateness that they wait for.

Rows of one (device, boot) may arrive out of order within a micro-batch: keyed-state jobs sort them by position first. Rows behind the
watermark are dropped by the windowed and joined jobs. sleep_durations, ambient_from_suspend and gap_events here replay a log that is in order
between micro-batches and keep the state of every boot; those in ``stateful`` are for streams that don't end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "1 hour"


def daily_histogram(temps: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Readings by device, day and temperature; a day is emitted when the watermark passes its end."""
    days = temps.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day").alias("w"), "device_id", "temp")
    return days.agg(F.count("*").alias("n")).select("device_id", F.date_format("w.start", "yyyyMMdd").alias("day"), "temp", "n")


def alarms_per_device_day(log: DataFrame, is_alarm: Column, watermark: str = WATERMARK) -> DataFrame:
    """Delivered alarms by device and day."""
    days = log.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day").alias("w"), "device_id")
    return days.agg(F.count_if(is_alarm).alias("num_alarms")).select("device_id", F.date_format("w.start", "yyyyMMdd").alias("day"), "num_alarms")


def trailing_distribution(temps: DataFrame, period: str = "24 hours", slide: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """Histogram of the trailing period at every slide; the batch operator is exact at every reading."""
    windows = temps.withWatermark("ts", watermark).groupBy(F.window("ts", period, slide).alias("w"), "device_id", "boot_id", "temp")
    return windows.agg(F.count("*").alias("n")).select("device_id", "boot_id", F.col("w.end").alias("at"), "temp", "n")


def dedup_lines(log: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Each line once, as long as its copies come within the watermark."""
    return log.withColumn("line_md5", F.md5("line")).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["device_id", "boot_id", "line_md5"])


def readings_of_alarms(alarms: DataFrame, temps: DataFrame, watermark: str = WATERMARK, longest: str = "101 hours") -> DataFrame:
    """Alarms with the readings of their windows: a join of two streams whose state the longest window bounds.

    alarms: alarm_ts (event time), start_ts, end_ts. A reading belongs to [start_ts, end_ts).
    """
    a = alarms.withWatermark("alarm_ts", watermark).alias("a")
    t = temps.withWatermark("ts", watermark).alias("t")
    inside = (F.col("t.ts") >= F.col("a.start_ts")) & (F.col("t.ts") < F.col("a.end_ts"))
    bound = F.expr(f"t.ts >= a.alarm_ts - interval {longest} and t.ts <= a.alarm_ts + interval {longest}")
    same = (F.col("a.device_id") == F.col("t.device_id")) & (F.col("a.boot_id") == F.col("t.boot_id"))
    return a.join(t, same & inside & bound).select("a.device_id", "a.boot_id", "a.alarm_key", "t.ts", "t.temp")


def idle_sessions(events: DataFrame, gap: Column | str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Sessions that end when a boot has been idle for the gap, which may differ from row to row; for tables and for streams.

    An event lasts from its time until the gap is over, and a session is what such spans cover without a break. A stream gives a session when
    the watermark passes its end.
    """
    spans = events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), "device_id", "boot_id")
    return spans.agg(F.count("*").alias("n")).select("device_id", "boot_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sleep_durations(events: DataFrame) -> DataFrame:
    """Per suspend exit the time since the latest entry, with one number of state per boot."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entry = state.get[0] if state.exists else -1
        out = []
        for r in pd.concat(list(batches)).sort_values(["token", "line_id"]).itertuples():
            if r.pm == "entry":
                entry = r.ts_us
            elif r.pm == "exit":
                out.append((*key, r.line_id, (r.ts_us - entry) * 1000 if entry >= 0 else -1))
        state.update((int(entry),))
        yield pd.DataFrame(out, columns=["device_id", "boot_id", "line_id", "sleep_ns"])

    rows = events.where("pm is not null").select("device_id", "boot_id", "token", "line_id", "ts_us", "pm")
    return rows.groupBy("device_id", "boot_id").applyInPandasWithState(step, "device_id string, boot_id string, line_id long, sleep_ns long", "entry long", "append", GroupStateTimeout.NoTimeout)


def ambient_from_suspend(events: DataFrame, least_sleep_us: int = 1_200_000_000, max_temp: int = 35) -> DataFrame:
    """The first reading of at most max_temp after each long sleep, with five numbers of state per boot (-1: none)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entry, left, before, temp, waiting = state.get if state.exists else (-1, -1, 0, 0, 0)
        out = []
        for r in pd.concat(list(batches)).sort_values(["token", "line_id"]).itertuples():
            if r.pm == "entry":
                if left < 0 or before == 0 or temp > before:
                    entry, before = r.ts_us, temp
                    waiting = waiting if left < 0 else 0
            elif r.pm == "exit":
                left = r.ts_us
                if entry >= 0 and left - entry > least_sleep_us:
                    waiting = 1
            else:
                temp = int(r.temp)
                if waiting and temp <= max_temp:
                    out.append((*key, r.ts_us, temp))
                    waiting, entry, left = 0, -1, -1
        state.update(tuple(int(x) for x in (entry, left, before, temp, waiting)))
        yield pd.DataFrame(out, columns=["device_id", "boot_id", "ts_us", "ambient_temp"])

    rows = events.where("pm is not null or temp is not null").select("device_id", "boot_id", "token", "line_id", "ts_us", "pm", "temp")
    schema = "device_id string, boot_id string, ts_us long, ambient_temp int"
    return rows.groupBy("device_id", "boot_id").applyInPandasWithState(step, schema, "entry long, gone long, before long, temp long, waiting long", "append", GroupStateTimeout.NoTimeout)


def gap_events(log: DataFrame) -> DataFrame:
    """The lines before which tokens are missing, with the last token of each boot as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["token", "line_id"])
        previous = rows.token.shift(fill_value=before)
        found = rows[(previous != 0) & (rows.token > previous + 1)]
        state.update((int(rows.token.iloc[-1]),))
        yield pd.DataFrame({"device_id": key[0], "boot_id": key[1], "line_id": found.line_id, "token": found.token})

    rows = log.select("device_id", "boot_id", "token", "line_id")
    return rows.groupBy("device_id", "boot_id").applyInPandasWithState(step, "device_id string, boot_id string, line_id long, token long", "before long", "append", GroupStateTimeout.NoTimeout)


def pending_sessions(events: DataFrame, watermark: str = WATERMARK, max_session: str = "2 hours") -> DataFrame:
    """Wake sessions (exit to next entry); a session that no entry closes within max_session is dropped by an event-time timer."""
    limit_ms = int(pd.Timedelta(max_session).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["device_id", "boot_id", "wake_us", "sleep_us"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        wake, out = state.get[0] if state.exists else -1, []
        for r in pd.concat(list(batches)).sort_values(["token", "line_id"]).itertuples():
            if r.pm == "exit":
                wake = r.ts_us
            elif wake >= 0:
                if r.pm == "entry" and r.ts_us - wake <= limit_ms * 1000:
                    out.append((*key, wake, r.ts_us))
                wake = -1
        if wake >= 0:
            state.update((int(wake),))
            state.setTimeoutTimestamp(max(wake // 1000 + limit_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=columns)

    resets = (F.col("charge") == "charging") | (F.col("screen") == "on")
    rows = events.withColumn("pm", F.when(resets, "reset").otherwise(F.col("pm"))).where("pm is not null").withWatermark("ts", watermark)
    rows = rows.select("device_id", "boot_id", "token", "line_id", "ts", "ts_us", "pm")
    return rows.groupBy("device_id", "boot_id").applyInPandasWithState(step, "device_id string, boot_id string, wake_us long, sleep_us long", "wake long", "append", GroupStateTimeout.EventTimeTimeout)
