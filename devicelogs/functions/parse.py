"""Typed events from log lines. Lines that don't match are null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Device, epoch ms, the same with fraction, boot, token, trace time, datetime, pid, tid, level, tag, payload.
HEADER = r"^(\S+)\s+(\d+)\s+(\S+)\s+(\S+)\s+(\d+)\s+(\S+)\s+(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d+)\s+(\d+)\s+(\d+)\s+(\w)\s+(\S+)\s+(.*)$"
#: How a line begins: device and epoch ms.
BEGUN = r"^\S+\s+\d+(\s|$)"
FIELDS = (("device_id", "string"), ("epoch_ms", "bigint"), ("epoch_ms_frac", "string"), ("boot_id", "string"), ("token", "bigint"), ("trace_time", "double"), ("ts", "timestamp"), ("pid", "int"), ("tid", "int"), ("level", "string"), ("tag", "string"), ("payload", "string"))

# Markers and patterns of the log format.
DELIVER = '{"func":"AlarmManagerService->deliverAlarmsLocked()"'
SCREEN = r"Set power mode=(\d), type=(\d) flinger=(0x[a-z0-9]+)"
PM_SUSPEND = r"PM: suspend (entry|exit)"
#: The log clock runs so many milliseconds behind the alarms' clock.
RTC_OFFSET_MS = 18_000_000

ALARM = "what string, type int, origWhen bigint, wakeup boolean, tag string, flags int, uid int, count int, when bigint, windowLength bigint, whenElapsed bigint, maxWhenElapsed bigint, repeatInterval bigint, pid int, operation string, uuid string, whenRtc bigint, maxWhenRtc bigint, creatorPkg string, targetPkg string, appPid int"
DELIVERED = "func string, nowELAPSED bigint, rtc bigint, alarm string"
SET_ALARM = "func string, pid int, uid int, flagsBinary string, flags int, alarmClock string, type int, triggerAtTime bigint, nowELAPSED bigint, rtc bigint, windowLength bigint, interval bigint, creatorPkg string, targetPkg string"
WAKELOCK = "func string, lock bigint, tag string, flags int, pid int, uid int, workSource string"
BATTERY = "BatteryProperties struct<ChargerAcOnline:boolean,ChargerUsbOnline:boolean,ChargerWirelessOnline:boolean>"


def parse_loglines(raw: DataFrame, line: str = "value") -> DataFrame:
    """The header fields, ts_us, and the line with its md5. Lines without a header are left out; see rejected."""
    found = raw.where(F.col(line).rlike(HEADER)).withColumn("_parts", F.split(line, r"\s+", 13))  # the time has two parts
    part = lambda k: F.concat_ws(" ", F.get("_parts", F.lit(6)), F.get("_parts", F.lit(7))) if k == 6 else F.get("_parts", F.lit(k + (k > 6)))
    columns = [part(k).try_cast(kind).alias(name) for k, (name, kind) in enumerate(FIELDS)]
    more = [c for c in raw.columns if c != line]
    parsed = found.select(*columns, F.col(line).alias("line"), F.md5(line).alias("line_id"), *more)
    return parsed.withColumn("ts_us", F.unix_micros("ts"))


def rejected(raw: DataFrame, line: str = "value") -> DataFrame:
    """The lines without a header."""
    return raw.where(~F.coalesce(F.col(line).rlike(HEADER), F.lit(False)))


def _kind_of_line(line: str) -> Column:
    """parsed; cut: begins as a line does and ends before its payload; rejected."""
    column = F.coalesce(F.col(line), F.lit(""))
    return F.when(column.rlike(HEADER), "parsed").when(column.rlike(BEGUN), "cut").otherwise("rejected")


def counted_lines(raw: DataFrame, metrics: Observation | str, line: str = "value") -> DataFrame:
    """raw unchanged; lines, parsed, rejected and cut are counted on the way, in the same job.

    They are in ``metrics.get`` after an action if it is an Observation, and in each progress of a stream (observedMetrics) if it is a name.
    """
    kind = _kind_of_line(line)
    counts = [F.count_if(kind == k).alias(k) for k in ("parsed", "rejected", "cut")]
    return raw.observe(metrics, F.count(F.lit(1)).alias("lines"), *counts)


def lines_by_file(raw: DataFrame, line: str = "value", file: str = "file") -> DataFrame:
    """file, lines, parsed, rejected and cut of each file (a column of its name)."""
    kinds = raw.select(file, _kind_of_line(line).alias("_kind")).groupBy(file)
    return kinds.agg(F.count("*").alias("lines"), *[F.count_if(F.col("_kind") == k).alias(k) for k in ("parsed", "rejected", "cut")])


def extract_alarms(log: DataFrame, require_prefix: bool = True, rtc_offset_ms: int = RTC_OFFSET_MS) -> DataFrame:
    """Delivered alarms with their fields flat, alarm_key, and the derived when_rtc_ms and max_when_rtc_ms."""
    rows = log.where(F.col("payload").startswith(DELIVER)) if require_prefix else log
    outer = rows.withColumn("_d", F.from_json("payload", DELIVERED)).where("_d.alarm is not null")
    inner = outer.withColumn("_a", F.from_json(F.regexp_replace("_d.alarm", r'\\"', '"'), ALARM)).where("_a is not null")
    when = F.col("_d.rtc") - (F.col("_d.nowELAPSED") - F.col("_a.whenElapsed")) - rtc_offset_ms
    names = {"type": "alarm_type", "tag": "alarm_tag", "pid": "alarm_pid", "uid": "alarm_uid", "windowLength": "window_length_ms", "whenElapsed": "when_elapsed", "creatorPkg": "creator_pkg", "targetPkg": "target_pkg", "appPid": "app_pid", "uuid": "uuid", "count": "count", "flags": "flags", "wakeup": "wakeup", "what": "what", "origWhen": "orig_when", "when": "when_ms", "maxWhenElapsed": "max_when_elapsed", "repeatInterval": "repeat_interval", "operation": "operation", "whenRtc": "json_when_rtc", "maxWhenRtc": "json_max_when_rtc"}
    flat = [F.col(f"_a.{k}").alias(v) for k, v in names.items()]
    made = inner.select(*log.columns, *flat, F.col("_d.func").alias("func"), F.col("_d.nowELAPSED").alias("now_elapsed"), F.col("_d.rtc").alias("rtc"), when.alias("when_rtc_ms"), (when + F.col("_a.windowLength")).alias("max_when_rtc_ms"), F.md5("line").alias("alarm_key"))
    return made.withColumns({"when_rtc_us": F.col("when_rtc_ms") * 1000, "max_when_us": F.col("max_when_rtc_ms") * 1000, "late_us": (F.col("now_elapsed") - F.col("when_elapsed")) * 1000})


def extract_set_alarms(log: DataFrame) -> DataFrame:
    """Alarms that were set."""
    rows = log.withColumn("_s", F.from_json("payload", SET_ALARM)).where("_s.triggerAtTime is not null")
    return rows.select(*log.columns, *[F.col(f"_s.{k}").alias(v) for k, v in (("func", "func"), ("pid", "alarm_pid"), ("uid", "alarm_uid"), ("flags", "flags"), ("type", "alarm_type"), ("triggerAtTime", "trigger_at"), ("windowLength", "window_length_ms"), ("interval", "interval"), ("creatorPkg", "creator_pkg"), ("targetPkg", "target_pkg"))])


def extract_screen(log: DataFrame) -> DataFrame:
    """Screen lines with mode, type and addr."""
    rows = log.where(F.col("payload").rlike(SCREEN))
    part = lambda k: F.regexp_extract("payload", SCREEN, k)
    return rows.select(*log.columns, part(1).cast("int").alias("mode"), part(2).cast("int").alias("type"), F.conv(F.substring(part(3), 3, 16), 16, 10).cast("bigint").alias("addr"))


def wakelock_kind(func: Column) -> Column:
    return F.when(func == "acquireWakeLockInternal", "acquire").when(func == "releaseWakeLockInternal", "release").otherwise("unknown")


def extract_wakelocks(log: DataFrame) -> DataFrame:
    """Wakelock lines with their fields and kind."""
    rows = log.withColumn("_w", F.from_json("payload", WAKELOCK)).where("_w.lock is not null")
    return rows.select(*log.columns, F.col("_w.func").alias("func"), F.col("_w.lock").alias("lock"), F.col("_w.tag").alias("lock_tag"), F.col("_w.flags").alias("flags"), F.col("_w.pid").alias("lock_pid"), F.col("_w.uid").alias("uid"), F.col("_w.workSource").alias("work_source"), wakelock_kind(F.col("_w.func")).alias("kind"))


def extract_trace(log: DataFrame, tag: str, fields: dict[str, str], pattern: str = r"\b{tag}:\s*(.*)$", pair: str = r"(\w+)=(\S+)") -> DataFrame:
    """Kernel-trace lines of a tag with its k=v fields, cast to the given types; a field takes the place of a header column of its name."""
    body = F.regexp_extract("payload", pattern.format(tag=tag), 1)
    value = lambda k: F.regexp_extract(body, rf"\b{k}=(\S+)", 1)
    rows = log.where(F.col("payload").contains(f"{tag}:"))
    return rows.select(*[c for c in log.columns if c not in fields], *[F.when(value(k) != "", value(k)).try_cast(kind).alias(k) for k, kind in fields.items()])


def extract_pm(log: DataFrame) -> DataFrame:
    """Suspend entries and exits."""
    state = F.regexp_extract("payload", PM_SUSPEND, 1)
    return log.where(F.col("payload").rlike(PM_SUSPEND)).select(*log.columns, state.alias("pm"))


def extract_battery(log: DataFrame) -> DataFrame:
    """Battery lines with the three chargers."""
    rows = log.withColumn("_b", F.from_json("payload", BATTERY)).where("_b.BatteryProperties is not null")
    chargers = {"ac": "ChargerAcOnline", "usb": "ChargerUsbOnline", "wireless": "ChargerWirelessOnline"}
    return rows.select(*log.columns, *[F.col(f"_b.BatteryProperties.{v}").alias(k) for k, v in chargers.items()])


def extract_healthd(log: DataFrame, pattern: str = r"\bchg=(\S*)") -> DataFrame:
    """Healthd lines with their charge field, which may be empty."""
    return log.where(F.col("payload").rlike(pattern)).select(*log.columns, F.regexp_extract("payload", pattern, 1).alias("chg"))
