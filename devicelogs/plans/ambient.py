"""Two jobs whose next step depends on the last: ambient temperature after suspends, and wakelock holds of alarms.

Spark reduces the tables first and deals them out; a small sorted helper then walks one stream's few rows of such events. Ambient
temperatures of a boot that is too long for that are walked in slices. A slice doesn't know the state that it is entered with, so it is first
summed up as a table from the state at its entry to the state at its exit: by cases of what is known, and by intervals of the last
temperature and of the last suspend where these decide. A scan over a boot's tables, one row for each slice, gives every slice the state it is
entered with; then all slices are walked at once.
"""

from __future__ import annotations

import json
from collections import defaultdict, deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.states import ctx_periods
from ..operators.timeops import KEYS, ORDER, following, gap_epochs, interval_join, last, running, total, written
from .sessions import _shares, temps_within, with_frequency

SECOND = 1_000_000


def reduce_for_ambient(events: DataFrame, max_temp: int = 35, require_unplugged: bool = False, keys=KEYS, slices=None) -> DataFrame:
    """Suspend events (while unplugged, if that is required) with temp_before, the time of the exit before, and the first cool reading before the next suspend event: all that the helper needs."""
    reading = F.when(F.col("pm").isNull() & F.col("temp").isNotNull(), F.struct("temp", "ts_us"))
    rows = events.withColumn("_reading", reading)
    if require_unplugged:
        rows = running(rows, {"_charge": last(F.col("charge"))}, keys, slices=slices)
        rows = rows.withColumn("pm", F.when(F.col("_charge") == "unplugged", F.col("pm")))
    is_pm, cool = F.col("pm").isNotNull(), F.when(F.col("_reading.temp") <= max_temp, F.col("_reading"))
    specs = {"_before": last(F.col("_reading")), "_cool": following(cool), "_next": following(F.when(is_pm, F.col("ts_us"))), "_gone": last(F.when(F.col("pm") == "exit", F.col("ts_us")), False)}
    seen = running(rows, specs, keys, slices=slices).where(is_pm)
    order = [c for c in ("token", "trace_time", "line_id") if c in events.columns]
    near = F.when(F.col("_next").isNull() | (F.col("_cool.ts_us") <= F.col("_next")), F.col("_cool"))
    return seen.select(*keys, *order, "ts_us", "pm", F.coalesce("_before.temp", F.lit(0)).cast("long").alias("temp_before"), F.col("_gone").alias("gone_us"), near["temp"].cast("long").alias("cool_temp"), near["ts_us"].alias("cool_ts"))


#: Before a boot's first event: the last suspend, whether an exit came since the last result, the temperature before the last suspend, whether a reading is waited for.
_START = (None, False, 0, False)
_FAR = 1 << 62


def _short(r: dict, left: bool, least_awake_us: int | None) -> bool:
    """Whether a suspend event ends a wake-up that may count as none."""
    return left and (least_awake_us is None or r["ts_us"] - r["gone_us"] < least_awake_us)


def _known(x) -> bool:
    return x is not None and not pd.isna(x)


def _ordered(rows: pd.DataFrame, order: list[str]) -> list[dict]:
    return rows.sort_values(order).to_dict("records")


def _walk(order: list[str], least_sleep_us: int, least_awake_us: int | None) -> Callable:
    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        entry, left, before, waiting = _START
        if "s_left" in rows.columns:  # a slice with the state that it is entered with
            head = rows.iloc[0]
            entry, left, before, waiting = (int(head.s_entry) if _known(head.s_entry) else None), bool(head.s_left), int(head.s_before), bool(head.s_waiting)
        found = []
        for r in _ordered(rows, order):
            if r["pm"] == "entry":
                if not (_short(r, left, least_awake_us) and before != 0 and r["temp_before"] <= before):
                    before, entry, waiting = r["temp_before"], r["ts_us"], waiting and not left
            else:
                left = True
                waiting = waiting or (entry is not None and r["ts_us"] - entry > least_sleep_us)
            if waiting and _known(r["cool_ts"]):
                found.append((r["device_id"], r["boot_id"], int(r["cool_ts"]), int(r["cool_temp"])))
                entry, left, waiting = None, False, False
        return pd.DataFrame(found, columns=["device_id", "boot_id", "ts_us", "ambient_temp"])

    return walk


def transfer(records: list[dict], least_sleep_us: int, least_awake_us: int | None) -> list[list]:
    """A slice as rows (entry known, left, waiting; intervals of before and of entry; state at the exit).

    The intervals hold for the state at the entry to the slice. In the state at its exit "e" and "b" stand for the entry and the before that
    the slice was entered with. Slices that were entered differently soon agree, and are then followed as one.
    """
    cases = [(e, left, w) for e in (False, True) for left in (False, True) for w in (False, True) if not w or (e and left)]
    thirds = [(-_FAR, -1), (0, 0), (1, _FAR)]  # a temperature of 0 counts as none
    cells: dict[tuple, list] = {}
    for e, left, w in cases:
        cells[("e" if e else None, left, "b", w)] = [((e, left, w), b, (-_FAR, _FAR)) for b in thirds]
    for r in records:
        moved: dict[tuple, list] = defaultdict(list)
        for (entry, left, before, waiting), guards in cells.items():
            parts: list[tuple[tuple, list]]
            if r["pm"] == "entry":
                kept, taken = (entry, left, before, waiting), (r["ts_us"], left, r["temp_before"], waiting and not left)
                limit = r["temp_before"]
                if not _short(r, left, least_awake_us):
                    parts = [(taken, guards)]
                elif before != "b":
                    parts = [(kept if before != 0 and limit <= before else taken, guards)]
                else:
                    parts = [(kept, []), (taken, [])]
                    for case, (low, high), e in guards:
                        if low == high == 0:
                            parts[1][1].append((case, (0, 0), e))
                            continue
                        if low < limit:
                            parts[1][1].append((case, (low, min(high, limit - 1)), e))
                        if high >= limit:
                            parts[0][1].append((case, (max(low, limit), high), e))
            else:
                limit = r["ts_us"] - least_sleep_us  # a suspend before that was long enough
                if waiting or entry is None:
                    parts = [((entry, True, before, waiting), guards)]
                elif entry != "e":
                    parts = [((entry, True, before, entry < limit), guards)]
                else:
                    parts = [((entry, True, before, True), []), ((entry, True, before, False), [])]
                    for case, b, (low, high) in guards:
                        if low < limit:
                            parts[0][1].append((case, b, (low, min(high, limit - 1))))
                        if high >= limit:
                            parts[1][1].append((case, b, (max(low, limit), high)))
            for state, chosen in parts:
                if chosen:
                    if state[3] and _known(r["cool_ts"]):
                        state = (None, False, state[2], False)
                    moved[state] += chosen
        cells = moved
    return [[*case, *b, *e, *state] for state, guards in cells.items() for case, b, e in guards]


def enter(table: list[list], state: tuple) -> tuple:
    """The state at the exit of a slice that is entered with state."""
    entry, left, before, waiting = state
    for known, l, w, b_low, b_high, e_low, e_high, *out in table:
        if (known, l, w) == (entry is not None, left, waiting) and b_low <= before <= b_high and (entry is None or e_low <= entry <= e_high):
            return (entry if out[0] == "e" else out[0], out[1], before if out[2] == "b" else out[2], out[3])
    raise ValueError(f"no row for the state {state}")


_SLICE = "device_id string, boot_id string, _slice long"


def _tables(order: list[str], least_sleep_us: int, least_awake_us: int | None) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        records = [{k: int(v) if k.endswith("_us") and _known(v) else v for k, v in r.items()} for r in _ordered(rows, order)]
        found = json.dumps(transfer(records, least_sleep_us, least_awake_us), default=int)
        return pd.DataFrame([(rows.device_id.iloc[0], rows.boot_id.iloc[0], int(rows["_slice"].iloc[0]), found)], columns=["device_id", "boot_id", "_slice", "found"])

    return run


def _scan(rows: pd.DataFrame) -> pd.DataFrame:
    state, out = _START, []
    for r in rows.sort_values("_slice").to_dict("records"):
        out.append((r["device_id"], r["boot_id"], int(r["_slice"]), *state))
        state = enter(json.loads(r["found"]), state)
    made = pd.DataFrame(out, columns=["device_id", "boot_id", "_slice", "s_entry", "s_left", "s_before", "s_waiting"])
    return made.astype({"s_entry": "Int64"})


def ambient_from_suspend(events: DataFrame, least_sleep_us: int = 1200 * SECOND, max_temp: int = 35, least_awake_us: int | None = None, require_unplugged: bool = False, keys=KEYS, slices=None) -> DataFrame:
    """The first reading of at most max_temp after each long sleep, with its day.

    A wake-up that does not warm the device counts as none, if it is shorter than least_awake_us where that is given. ``slices``, a number that
    doesn't fall along the order of token, trace_time and line_id, bounds what one task walks.
    """
    small = reduce_for_ambient(events, max_temp, require_unplugged, keys, slices)
    order, limits = [c for c in ("token", "trace_time", "line_id") if c in small.columns], (least_sleep_us, least_awake_us)
    by = [*keys]
    if slices is not None:
        by = [*keys, "_slice"]
        small = written(small.withColumn("_slice", slices.cast("long")))
        tables = small.groupBy(*by).applyInPandas(_tables(order, *limits), f"{_SLICE}, found string")
        starts = written(tables.groupBy(*keys).applyInPandas(_scan, f"{_SLICE}, s_entry long, s_left boolean, s_before long, s_waiting boolean"))
        small = small.join(starts, by)
    found = small.groupBy(*by).applyInPandas(_walk(order, *limits), "device_id string, boot_id string, ts_us long, ambient_temp int")
    return found.withColumn("day", F.date_format(F.timestamp_micros("ts_us"), "yyyyMMdd"))


def _holds(tail_us: int):
    """Pairs the locks of one epoch, in the log's order: clocks may go back between lines. A release belongs to the acquire of its lock, whoever
    calls it; the alarm goes the tail after the hold."""

    def holds(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        queues: defaultdict[int, deque] = defaultdict(deque)  # alarms that wait, by pid
        owner: dict[int, int] = {}  # pid that acquired an open lock
        count: defaultdict[int, int] = defaultdict(int)
        first: dict[int, int] = {}  # acquire that began a pid's hold
        ended: list[tuple[int, int, int]] = []  # pid, acquire, release of holds whose tail runs

        def serve(now: int) -> None:
            while ended and now - ended[0][2] > tail_us:
                pid, acquire, release = ended.pop(0)
                if queues[pid]:
                    alarm = queues[pid].popleft()
                    found.append((rows.device_id.iloc[0], rows.boot_id.iloc[0], pid, alarm["alarm_key"], int(alarm["ts_us"]), acquire, release, release + tail_us))

        for r in rows.sort_values([c for c in ORDER if c in rows.columns]).to_dict("records"):
            now = int(r["ts_us"])
            serve(now)
            if r["what"] == "alarm":
                queues[int(r["pid"])].append(r)
            elif r["what"] == "acquire":
                pid = int(r["pid"])
                if queues[pid]:
                    owner[r["lock"]] = pid
                    if count[pid] == 0:
                        first[pid] = now
                    count[pid] += 1
            elif r["lock"] in owner:
                pid = owner.pop(r["lock"])
                count[pid] = max(count[pid] - 1, 0)
                if count[pid] == 0 and pid in first:
                    ended.append((pid, first.pop(pid), now))
        serve(int(rows.last_us.max()))
        return pd.DataFrame(found, columns=["device_id", "boot_id", "pid", "alarm_key", "alarm_us", "acquire_us", "release_us", "until_us"])

    return holds


def wakelock_holds(events: DataFrame, tail_us: int = 10 * SECOND, keys=KEYS, slices=None) -> DataFrame:
    """Per process and alarm the hold from the first acquire until no lock of the process is open, while unplugged with the screen off.

    events: as for sessions, with what (alarm, acquire, release or null), pid, lock and alarm_key. A gap, charging and the screen turning on
    clear all that waits. An alarm waits until the tail after its hold has passed; of waiting alarms the oldest is served.
    """
    counted = gap_epochs(events, keys, slices)
    resets = (F.col("charge") == "charging") | (F.col("screen") == "on")
    scope = (*keys, "gap_epoch")
    stated = running(counted, {"_charge": last(F.col("charge")), "_screen": last(F.col("screen")), "reset_id": total(F.coalesce(resets.cast("long"), F.lit(0)))}, scope, slices=slices)
    epoch = [*scope, "reset_id"]
    ends = stated.groupBy(*epoch).agg(F.max("ts_us").alias("last_us"))
    dark = (F.col("_charge") == "unplugged") & (F.col("_screen") == "off")
    small = stated.where("what is not null").where((F.col("what") != "alarm") | dark).select(*epoch, *[c for c in ORDER if c in events.columns], "pid", "ts_us", "what", "lock", "alarm_key")
    waiting = small.where("what = 'alarm'").select(*epoch, "pid").distinct()
    taken = small.where("what <> 'release'").join(waiting, [*epoch, "pid"], "left_semi")
    released = small.where("what = 'release'").join(taken.where("what = 'acquire'").select(*epoch, "lock").distinct(), [*epoch, "lock"], "left_semi")
    rows = taken.unionByName(released).join(ends, epoch)
    schema = "device_id string, boot_id string, pid long, alarm_key string, alarm_us long, acquire_us long, release_us long, until_us long"
    return rows.groupBy(*epoch).applyInPandas(_holds(tail_us), schema)


def alarm_wakelock_cpu(holds: DataFrame, ctx: DataFrame, freq: DataFrame, temps: DataFrame | None = None, bucket_us: int = 3600 * SECOND, keys=KEYS) -> DataFrame:
    """Per hold and row of its process (by tgid or pid) inside a period between acquire and tail: the row's share, the period's total and the
    cpu's frequency at the period's end, which is unknown at the acquire; rows before the cpu's first frequency are left out, and so are
    holds without a row. With temps, the temperatures of the hold."""
    spans = holds.withColumnRenamed("pid", "hold_pid")
    scope = (*keys, "alarm_key", "acquire_us")
    inside = interval_join(spans, ctx, "acquire_us", "until_us", bucket_us, keys=keys, closed=True)
    rows = _shares(ctx_periods(inside, scope), scope)
    matched = rows.where((F.col("tgid") == F.col("hold_pid")) | (F.col("pid") == F.col("hold_pid")))
    known = with_frequency(matched, freq, "end_ts_us", "acquire_us", keys)
    found = known.select(*scope, "hold_pid", "cpu", "period_id", "line_id", "period_total", "share", "frequency", (F.col("release_us") - F.col("acquire_us")).alias("duration_us"))
    if temps is None:
        return found
    read = temps_within(spans.withColumn("_start", F.col("acquire_us")), temps, "_start", "until_us", ["alarm_key", "acquire_us"], bucket_us, keys, True)
    return found.join(read, [*scope], "left")


def mean_hold(holds: DataFrame) -> DataFrame:
    """Mean hold in seconds by device."""
    return holds.groupBy("device_id").agg(F.avg((F.col("release_us") - F.col("acquire_us")) / 1e6).alias("mean_hold_s"))
