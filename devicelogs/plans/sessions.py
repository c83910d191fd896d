"""Wake sessions and CPU use.

events: device_id, boot_id, token, trace_time, line_id, ts_us, gap, pm (entry / exit), screen (on / off), charge (charging / unplugged).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.states import busyness, cpu_snapshot, ctx_periods
from ..operators.timeops import KEYS, following, gap_epochs, interval_join, last, running

SECOND, HOUR = 1_000_000, 3_600_000_000


def wake_sessions(events: DataFrame, max_session_us: int = 2 * HOUR, keys=KEYS, slices: Column | None = None) -> DataFrame:
    """Sessions from a suspend exit, with the screen off and unplugged, to the next entry.

    A gap, the start of charging, and the screen turning on drop a session that is open; a session that is longer than max_session_us
    counts as none. States are unknown after a gap.
    """
    counted = gap_epochs(events, keys, slices)
    scope = (*keys, "gap_epoch")
    stated = running(counted, {"_charge": last(F.col("charge")), "_screen": last(F.col("screen"))}, scope, slices=slices)
    resets = (F.col("charge") == "charging") | (F.col("screen") == "on")
    opens = (F.col("pm") == "exit") & (F.col("_screen") == "off") & (F.col("_charge") == "unplugged")
    small = stated.where("pm is not null or charge = 'charging' or screen = 'on'")
    kind = F.when(resets, "reset").when(F.col("pm") == "entry", "entry").when(opens, "open").otherwise("exit")
    marked = small.withColumn("_kind", kind).withColumn("_what", F.struct(F.col("_kind").alias("kind"), F.col("ts_us").alias("ts_us"), F.col("line_id").alias("line_id")))
    paired = running(marked, {"_next": following(F.when(F.col("_kind").isin("reset", "entry"), F.col("_what")))}, scope, slices=slices)
    found = paired.where((F.col("_kind") == "open") & (F.col("_next.kind") == "entry"))
    length = F.col("_next.ts_us") - F.col("ts_us")
    return found.where(length <= max_session_us).select(*keys, F.col("line_id").alias("session_id"), F.col("ts_us").alias("wake_us"), F.col("_next.ts_us").alias("sleep_us"), length.alias("duration_us"))


def sessions_with_alarms(sessions: DataFrame, alarms: DataFrame, within_us: int | None = None, bucket_us: int = 2 * HOUR, keys=KEYS) -> DataFrame:
    """Sessions with the alarms delivered inside of them, or within their first microseconds."""
    limit = F.col("sleep_us") if within_us is None else F.least(F.col("sleep_us"), F.col("wake_us") + within_us + 1)
    spans = sessions.withColumn("_until", limit)
    return interval_join(spans, alarms.select(*keys, "ts_us", "alarm_key", "app_pid"), "wake_us", "_until", bucket_us, keys=keys).withColumnRenamed("ts_us", "alarm_us").drop("_until")


def session_rows(sessions: DataFrame, rows: DataFrame, bucket_us: int = 2 * HOUR, keys=KEYS) -> DataFrame:
    """The rows (ctx, temps, frequencies) inside of each session."""
    return interval_join(sessions.select(*keys, "session_id", "wake_us", "sleep_us"), rows, "wake_us", "sleep_us", bucket_us, keys=keys)


def suspend_cpu(sessions: DataFrame, alarms: DataFrame, ctx: DataFrame, freq: DataFrame | None = None, bucket_us: int = 2 * HOUR, keys=KEYS) -> DataFrame:
    """Busyness of each cpu and context-switch period in the sessions that hold an alarm, with the cpu's frequency at the period's end."""
    chosen = sessions.join(sessions_with_alarms(sessions, alarms, None, bucket_us, keys).select(*keys, "session_id").distinct(), [*keys, "session_id"], "left_semi")
    inside = session_rows(chosen, ctx, bucket_us, keys)
    scope = (*keys, "session_id")
    periods = ctx_periods(inside, scope)
    busy = busyness(periods.withColumn("end_us", F.col("end_ts_us")), by=("period_id", "end_us"), keys=scope)
    return busy if freq is None else with_frequency(busy, freq, "end_us", keys=keys)


def with_frequency(rows: DataFrame, freq: DataFrame, at: str, since: str | None = None, keys=KEYS) -> DataFrame:
    """rows with the frequency of their cpu at a time; rows whose cpu has none yet (or none since a time) are left out."""
    return cpu_snapshot(rows, freq, at, since, keys).where("frequency is not null").drop("online")


def _shares(periods: DataFrame, scope: tuple) -> DataFrame:
    """Info rows of periods with period_total and the row's share of it."""
    whole = Window.partitionBy(*scope, "cpu", "period_id")
    timed = periods.withColumn("period_total", F.sum("rtime").over(whole))
    return timed.withColumn("share", F.try_divide(F.col("rtime"), F.col("period_total")))


def temps_within(spans: DataFrame, temps: DataFrame, start: str, end: str, by: list[str], bucket_us: int = 2 * HOUR, keys=KEYS, closed: bool = False) -> DataFrame:
    """Per span its readings as a list in time order."""
    inside = interval_join(spans.select(*keys, *by, start, end), temps.select(*keys, "ts_us", "temp"), start, end, bucket_us, keys=keys, closed=closed)
    return inside.groupBy(*keys, *by).agg(F.transform(F.sort_array(F.collect_list(F.struct("ts_us", "temp"))), lambda r: r["temp"]).alias("temps"))


def alarm_cpu(sessions: DataFrame, alarms: DataFrame, ctx: DataFrame, freq: DataFrame, within_us: int = 5 * SECOND, bucket_us: int = 2 * HOUR, keys=KEYS) -> DataFrame:
    """Per alarm in a session's first microseconds and row of its process (tgid): the row's share of its period, the period's total, the
    cpu's frequency at the period's end, and how long after the alarm the row came. Rows whose cpu has no frequency yet are left out."""
    early = sessions_with_alarms(sessions, alarms, within_us, bucket_us, keys)
    chosen = sessions.join(early.select(*keys, "session_id").distinct(), [*keys, "session_id"], "left_semi")
    scope = (*keys, "session_id")
    rows = _shares(ctx_periods(session_rows(chosen, ctx, bucket_us, keys), scope), scope)
    matched = rows.join(early.select(*scope, "alarm_key", "alarm_us", F.col("app_pid").alias("tgid")), [*scope, "tgid"])
    known = with_frequency(matched, freq, "end_ts_us", keys=keys)
    return known.select(*scope, "alarm_key", "cpu", "period_id", "line_id", "period_total", "share", "frequency", (F.col("ts_us") - F.col("alarm_us")).alias("after_us"))


def alarm_durations(used: DataFrame, sessions: DataFrame | None = None, temps: DataFrame | None = None, bucket_us: int = 2 * HOUR, keys=KEYS) -> DataFrame:
    """Per alarm the time from its delivery to the last row of its process, and the temperatures of its session if sessions and temps are given."""
    sums = used.groupBy(*keys, "session_id", "alarm_key").agg(F.max("after_us").alias("duration_us"), F.sum("share").alias("busy"))
    if sessions is None:
        return sums
    return sums.join(temps_within(sessions, temps, "wake_us", "sleep_us", ["session_id"], bucket_us, keys), [*keys, "session_id"], "left")


def busyness_data(used: DataFrame, by=("device_id", "alarm_key")) -> DataFrame:
    """Partial results: per alarm and cpu the lists of shares, period totals and frequencies, in the order of the rows, and the longest duration."""
    rows = F.sort_array(F.collect_list(F.struct("line_id", "share", "period_total", "frequency")))
    made = used.groupBy(*by, "cpu").agg(rows.alias("_r"), F.max("after_us").alias("duration_us"))
    return made.select(*by, "cpu", F.col("_r.share").alias("busyness"), F.col("_r.period_total").alias("periods"), F.col("_r.frequency").alias("frequency"), "duration_us")


def merge_results(*parts: DataFrame, by=("device_id", "cpu")) -> DataFrame:
    """Partial results as one: lists under one key are appended part by part, durations add up."""
    numbered = [p.select(*by, "busyness", "periods", "frequency", "duration_us", F.lit(k).alias("_part")) for k, p in enumerate(parts)]
    union = numbered[0]
    for p in numbered[1:]:
        union = union.unionByName(p)
    lists = F.sort_array(F.collect_list(F.struct("_part", "busyness", "periods", "frequency")))
    merged = union.groupBy(*by).agg(lists.alias("_l"), F.sum("duration_us").alias("duration_us"))
    return merged.select(*by, *[F.flatten(f"_l.{c}").alias(c) for c in ("busyness", "periods", "frequency")], "duration_us")


def screen_off_cpu(events: DataFrame, keys=KEYS, slices: Column | None = None) -> DataFrame:
    """While unplugged, per cpu event: the frequency before it and the trace time since the cpu's last frequency line.

    events: as above, with cpu, freq, hotplug and error. Samples count if the screen is off, or unknown and next turned on in the same gap
    epoch. Offline events count if they succeeded.
    """
    counted = gap_epochs(events, keys, slices)
    scope = (*keys, "gap_epoch")
    stated = running(counted, {"_charge": last(F.col("charge")), "_screen": last(F.col("screen"))}, scope, slices=slices)
    ahead = running(stated, {"_then": following(F.col("screen"))}, scope, slices=slices)
    cpu_rows = ahead.where("cpu is not null")
    before = running(cpu_rows, {"_last": last(F.when(F.col("freq").isNotNull(), F.struct("freq", "trace_time")), False)}, (*scope, "cpu"), slices=slices)
    counts = F.col("freq").isNotNull() | ((F.col("hotplug") == "offline") & (F.col("error") == 0))
    dark = (F.col("_screen") == "off") | (F.col("_screen").isNull() & (F.col("_then") == "on"))
    kept = before.where((F.col("_charge") == "unplugged") & counts & dark & F.col("_last").isNotNull())
    event = F.when(F.col("freq").isNotNull(), "frequency").otherwise("offline")
    return kept.select(*keys, "line_id", "cpu", event.alias("event_kind"), F.col("_last.freq").alias("prev_freq"), (F.col("trace_time") - F.col("_last.trace_time")).alias("duration_s"), "ts")


def screen_off_temps(events: DataFrame, keys=KEYS, slices: Column | None = None) -> DataFrame:
    """Readings while unplugged with the screen off."""
    counted = gap_epochs(events, keys, slices)
    stated = running(counted, {"_charge": last(F.col("charge")), "_screen": last(F.col("screen"))}, (*keys, "gap_epoch"), slices=slices)
    return stated.where("_charge = 'unplugged' and _screen = 'off' and temp is not null").select(*keys, "line_id", "ts", "temp")
