"""As-of device state. Whether the current row counts is part of each state's definition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeops import KEYS, last, running, total

#: A process that leaves the foreground counts as background after so many seconds.
BACKGROUND_DELAY_S = 1.0


def charge_value(ac: Column, usb: Column, wireless: Column) -> Column:
    """charging if any charger is online."""
    return F.when(ac | usb | wireless, "charging").otherwise("unplugged")


def screen_value(mode: Column) -> Column:
    """0 is off, 1 and 2 are on, other modes say nothing."""
    return F.when(mode == 0, "off").when(mode.isin(1, 2), "on")


def charge_state(events: DataFrame, keys=KEYS, slices: Column | None = None, state: str = "charge") -> DataFrame:
    """events with charge_state (this row included) and changed: whether this row turned it."""
    seen = running(events, {"charge_state": last(F.col(state)), "_was": last(F.col(state), False)}, keys, slices=slices)
    changed = F.col(state).isNotNull() & ~F.col(state).eqNullSafe(F.col("_was"))
    return seen.withColumn("changed", changed).withColumn("charge_state", F.coalesce("charge_state", F.lit("unknown"))).drop("_was")


def screen_state(events: DataFrame, keys=KEYS, slices: Column | None = None, mode: str = "mode") -> DataFrame:
    """events with screen_state, the row's own screen event included."""
    seen = running(events, {"screen_state": last(screen_value(F.col(mode)))}, keys, slices=slices)
    return seen.withColumn("screen_state", F.coalesce("screen_state", F.lit("unknown")))


def suspend_state(events: DataFrame, keys=KEYS, slices: Column | None = None, pm: str = "pm") -> DataFrame:
    """events with suspend_state before each row: entry suspends, exit wakes."""
    value = F.when(F.col(pm) == "entry", "suspended").when(F.col(pm) == "exit", "awake")
    seen = running(events, {"suspend_state": last(value, False)}, keys, slices=slices)
    return seen.withColumn("suspend_state", F.coalesce("suspend_state", F.lit("unknown")))


def cpu_state(events: DataFrame, keys=KEYS, slices: Column | None = None, order=("token", "trace_time", "line_id")) -> DataFrame:
    """events (cpu, freq or null, hotplug or null, error or null) with each cpu's freq_before and online_before this row."""
    online = F.when(F.col("freq").isNotNull(), "online").when(F.col("error") == 0, F.col("hotplug"))
    specs = {"freq_before": last(F.col("freq"), False), "online_before": last(online, False)}
    return running(events, specs, (*keys, "cpu"), order, slices)


def cpu_snapshot(probes: DataFrame, events: DataFrame, at: str, since: str | None = None, keys=KEYS, time: str = "ts_us", slices: Column | None = None) -> DataFrame:
    """probes with cpu, frequency and online: the state of every cpu of the probe's stream at a time, this time's events included.

    probes with a column cpu get the state of this cpu alone. ``since`` names a time before which nothing is known. A cpu that no event has
    named is left out. With a gap epoch among the keys, states don't reach over a gap.
    """
    named = events.where("cpu is not null")
    if "cpu" not in probes.columns:
        cpus = named.groupBy(*keys).agg(F.collect_set("cpu").alias("_cpus"))  # a device has few
        probes = probes.join(cpus, [*keys]).withColumn("cpu", F.explode("_cpus")).drop("_cpus")
    online = F.when(F.col("freq").isNotNull(), "online").when(F.col("error") == 0, F.col("hotplug")) if "hotplug" in events.columns else F.when(F.col("freq").isNotNull(), "online")
    when = F.col(time)
    states = named.select(*keys, "cpu", when.alias("_t"), F.when(F.col("freq").isNotNull(), F.struct(F.col("freq").alias("v"), when.alias("t"))).alias("_f"), F.when(online.isNotNull(), F.struct(online.alias("v"), when.alias("t"))).alias("_o"), F.struct(when.alias("t")).alias("_k"), F.lit(0).alias("_side"), F.lit(True).alias("_event"))
    union = probes.withColumns({"_t": F.col(at), "_side": F.lit(1)}).unionByName(states, allowMissingColumns=True)
    seen = running(union, {"_freq": last(F.col("_f")), "_online": last(F.col("_o")), "_known": last(F.col("_k"))}, (*keys, "cpu"), ("_t", "_side"), slices).where("_event is null and _known is not null")
    value = lambda c: F.col(f"{c}.v") if since is None else F.when(F.col(f"{c}.t") >= F.col(since), F.col(f"{c}.v"))
    return seen.select(*probes.columns, value("_freq").alias("frequency"), value("_online").alias("online"))


def cpu_last_event(events: DataFrame, keys=KEYS, slices: Column | None = None, order=("token", "trace_time", "line_id")) -> DataFrame:
    """Per row the id of the cpu's latest frequency or state line so far; of a tie the state line."""
    seen = running(events, {"_f": last(F.when(F.col("freq").isNotNull(), F.struct("ts_us", "line_id"))), "_s": last(F.when(F.col("hotplug").isNotNull(), F.struct("ts_us", "line_id")))}, (*keys, "cpu"), order, slices)
    pick = F.when(F.col("_f").isNull() | (F.col("_s.ts_us") >= F.col("_f.ts_us")), F.col("_s.line_id")).otherwise(F.col("_f.line_id"))
    return seen.withColumn("last_event_line", pick).drop("_f", "_s")


def fgbg_state(log: DataFrame, pid: str = "fg_pid", keys=KEYS, delay_s: float = BACKGROUND_DELAY_S, slices: Column | None = None) -> DataFrame:
    """log with fgbg_state: a foreground pid sets foreground; pid 0 sets background at the first line more than the delay after it."""
    event = F.when(F.col(pid).isNotNull(), F.struct(F.col(pid).alias("pid"), F.col("trace_time").alias("t")))
    seen = running(log, {"_e": last(event)}, keys, slices=slices)
    late = F.col("trace_time") - F.col("_e.t") > delay_s
    # within the delay the state before pid 0 holds, and a repeated pid 0 starts the delay anew only from a settled state
    seen = seen.withColumn("_settled", F.when((F.col("_e.pid") == 0) & late, "background").when(F.col("_e.pid") != 0, "foreground"))
    seen = running(seen, {"fgbg_state": last(F.col("_settled"))}, keys, slices=slices)
    return seen.withColumn("fgbg_state", F.coalesce("fgbg_state", F.lit("unknown"))).drop("_e", "_settled")


def healthd_state(log: DataFrame, charge: str = "chg", keys=KEYS, slices: Column | None = None) -> DataFrame:
    """log with charge_state from healthd lines: an empty charge field is charging."""
    value = F.when(F.col(charge) == "", "charging").when(F.col(charge).isNotNull(), "unplugged")
    return running(log, {"charge_state": last(value)}, keys, slices=slices)


def filter_by_charge_state(log: DataFrame, wanted=("unplugged",), charge: str = "chg", keys=KEYS, slices: Column | None = None) -> DataFrame:
    """The lines whose current healthd state is wanted."""
    return healthd_state(log, charge, keys, slices).where(F.col("charge_state").isin(*wanted)).drop("charge_state")


def apply_predicates(df: DataFrame, *predicates: Column) -> DataFrame:
    """The rows for which all predicates hold."""
    for p in predicates:
        df = df.where(p)
    return df


def day_key(ts: str | Column = "ts") -> Column:
    """Day label of a line, in the session's time zone (UTC)."""
    return F.date_format(ts, "yyyyMMdd")


# Context-switch periods


def ctx_periods(rows: DataFrame, keys=KEYS, order=("ts_us", "line_id"), slices: Column | None = None) -> DataFrame:
    """The info rows inside of periods, with period_id: from a cpu's first begin after the last end, to its next end.

    rows: cpu, kind (begin, info, end). Info or end without begin and periods without end are left out.
    """
    scope = (*keys, "cpu")
    counted = running(rows, {"period_id": total((F.col("kind") == "end").cast("long"), False)}, scope, order, slices)
    place, period = F.struct(*order), Window.partitionBy(*scope, "period_id")
    at = lambda kind: F.when(F.col("kind") == kind, place)
    marked = counted.withColumns({"_begin": F.min(at("begin")).over(period), "_end": F.max(at("end")).over(period)})
    inside = marked.where("kind = 'info'").where((place > F.col("_begin")) & (place < F.col("_end")))
    return inside.withColumn("end_ts_us", F.col("_end")[order[0]]).drop("_begin", "_end")


def busyness(periods: DataFrame, kind: str = "total", by=("period_id",), keys=KEYS) -> DataFrame:
    """Per period: total_time and the share of it outside of the swapper: all of it, its foreground or its background part."""
    amount = {"total": F.col("rtime"), "fg": F.col("rtime") - F.col("bg_rtime"), "bg": F.col("bg_rtime")}[kind]
    busy = F.sum(F.when(~F.col("comm").contains("swapper"), amount).otherwise(0))
    made = periods.groupBy(*keys, "cpu", *by).agg(F.sum("rtime").alias("total_time"), busy.alias("_busy"))
    share = F.when(F.col("total_time") == 0, 0.0).otherwise(F.col("_busy") / F.col("total_time"))
    return made.withColumn("busyness", share).drop("_busy")
