"""Keyed state with an end: jobs over endless streams of boots.

Rows of a boot may come in any order and in any micro-batch, as long as they are not behind the watermark. They wait in list state until the
watermark has passed them and are then walked in the order of ts_us, token and line_id; so the result doesn't depend on how the input is cut into
micro-batches, and equals the batch operator on all rows that the watermark has passed. Rows that come behind the watermark are dropped. An
event-time timer wakes a boot when its next row can be walked, and once more when it has been idle for ``idle``: then all its state goes,
and a later row begins it anew. The state of a boot is therefore the rows of one watermark's delay and what its walk remembers.

State is kept by the RocksDB provider, which ``start_with_rocksdb`` sets for a query that is about to start.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .jobs import WATERMARK

IDLE = "7 days"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = {_PROVIDER: _ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256"}
_KEY = "device_id string, boot_id string"
HOUR_US = 3_600_000_000
_ALARM = "ts_us long, alarm_key string, when_rtc_us long, max_when_us long, late_us long, window_length_ms long"
_CLOSED = "alarm_key string, window_length_ms long, close_us long, start_ts long, trigger_temp int, times array<long>, temps array<int>"
_SUMMED = _CLOSED.replace("times array<long>, temps array<int>", "readings long, min_temp int, last_temp int")
#: Rows or readings in one frame that is given out.
ROWS = 100_000
_ROW = {"ts_us": "long", "token": "long", "line_id": "long", "pm": "string", "temp": "int"}

Row = tuple  # ts_us, token, line_id, pm, temp
Walk = Callable[[tuple | None, list[Row]], tuple[tuple, list[tuple]]]


@contextmanager
def start_with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state by RocksDB, whose stores share an executor's bounded memory; the session's own settings come back after it."""
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class InOrder(StatefulProcessor):
    """Walks the rows of each boot in order, behind the watermark. Value state ``memory`` is what the walk remembers, with the last row's time before it."""

    #: The columns of a waiting row; the first three are the order.
    row = _ROW

    def __init__(self, walk: Walk, memory: str, columns: list[str], idle_ms: int):
        self.walk, self.schema, self.columns, self.idle_ms = walk, memory, columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} {t}" for c, t in self.row.items()))
        self.memory = handle.getValueState("memory", f"last_us long, {self.schema}")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows))
        fresh = [tuple(None if pd.isna(x) else x if isinstance(x, str) else int(x) for x in r) for r in fresh[list(self.row)].itertuples(index=False)]
        yield from self._frames(key, self._advance(key, fresh, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._frames(key, self._advance(key, [], timerValues.getCurrentWatermarkInMs()))

    def _advance(self, key: tuple, fresh: list[Row], watermark_ms: int) -> Iterable[tuple]:
        held = [*self.waiting.get(), *fresh] if self.waiting.exists() else fresh
        passed = sorted((tuple(r) for r in held if r[0] <= watermark_ms * 1000), key=lambda r: r[:3])
        rest = [tuple(r) for r in held if r[0] > watermark_ms * 1000]
        if passed or fresh:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        out, memory = [], tuple(self.memory.get()) if self.memory.exists() else None
        if passed:
            remembered, out = self.walk(memory and memory[1:], passed)
            memory = (passed[-1][0], *remembered)
            self.memory.update(memory)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if rest:
            self.handle.registerTimer(-(-min(r[0] for r in rest) // 1000))  # rounded up: a timer at the watermark itself would fire at once and be gone
        elif memory and memory[0] // 1000 + self.idle_ms <= watermark_ms:
            self.memory.clear()
        elif memory:
            self.handle.registerTimer(memory[0] // 1000 + self.idle_ms)
        return out

    def _frames(self, key: tuple, out: Iterable[tuple]) -> Iterator[pd.DataFrame]:
        """What a walk gives, in parts that memory holds where it can be much."""
        yield self._frame(key, out)

    def _frame(self, key: tuple, out: Iterable[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in out], columns=["device_id", "boot_id", *self.columns])

    def close(self) -> None:
        pass


def _timed(rows: DataFrame, watermark: str, where: str, without: tuple[str, ...] = ()) -> DataFrame:
    """The rows that a walk needs; all rows move the watermark on."""
    columns = [F.col(c).cast(t).alias(c) if c in rows.columns and c not in without else F.lit(None).cast(t).alias(c) for c, t in _ROW.items()]
    needed = F.when(F.col("ts").isNotNull(), F.expr(where))  # with ts in it the filter isn't pushed below the watermark
    return rows.withWatermark("ts", watermark).where(needed).select("device_id", "boot_id", "ts", *columns)


def _walked(timed: DataFrame, walk: Walk, memory: str, out: str, idle: str) -> DataFrame:
    processor = InOrder(walk, memory, [c.split()[0] for c in out.split(", ")], int(pd.Timedelta(idle).total_seconds() * 1000))
    return timed.groupBy("device_id", "boot_id").transformWithStateInPandas(processor, f"{_KEY}, {out}", "Append", "EventTime")


# The walks


def _gaps(memory: tuple | None, rows: list[Row]) -> tuple[tuple, list[tuple]]:
    before, out = memory[0] if memory else 0, []
    for _, token, line_id, _, _ in rows:
        if before and token > before + 1:
            out.append((line_id, token))
        before = token
    return (before,), out


def gap_events(log: DataFrame, watermark: str = WATERMARK, idle: str = IDLE) -> DataFrame:
    """The lines before which tokens are missing."""
    return _walked(_timed(log, watermark, "true", ("pm", "temp")), _gaps, "before long", "line_id long, token long", idle)


def _sleeps(memory: tuple | None, rows: list[Row]) -> tuple[tuple, list[tuple]]:
    entry, out = memory[0] if memory else None, []
    for ts_us, _, line_id, pm, _ in rows:
        if pm == "entry":
            entry = ts_us
        else:
            out.append((line_id, -1 if entry is None else (ts_us - entry) * 1000))
    return (entry,), out


def sleep_durations(events: DataFrame, watermark: str = WATERMARK, idle: str = IDLE) -> DataFrame:
    """Per suspend exit the time since the latest entry; -1 without one."""
    return _walked(_timed(events, watermark, "pm is not null", ("temp",)), _sleeps, "entry long", "line_id long, sleep_ns long", idle)


def _ambient(least_sleep_us: int, max_temp: int) -> Walk:
    def walk(memory: tuple | None, rows: list[Row]) -> tuple[tuple, list[tuple]]:
        entry, left, before, temp, waiting = memory or (None, None, 0, 0, False)
        out = []
        for ts_us, _, _, pm, reading in rows:
            if pm == "entry":
                if left is None or before == 0 or temp > before:
                    entry, before, waiting = ts_us, temp, waiting and left is None
            elif pm == "exit":
                left = ts_us
                waiting = waiting or (entry is not None and left - entry > least_sleep_us)
            else:
                temp = reading
                if waiting and temp <= max_temp:
                    out.append((ts_us, temp))
                    entry, left, waiting = None, None, False
        return (entry, left, before, temp, waiting), out

    return walk


def ambient_from_suspend(events: DataFrame, least_sleep_us: int = 1_200_000_000, max_temp: int = 35, watermark: str = WATERMARK, idle: str = IDLE) -> DataFrame:
    """The first reading of at most max_temp after each long sleep."""
    rows = _timed(events, watermark, "pm is not null or temp is not null")
    return _walked(rows, _ambient(least_sleep_us, max_temp), "entry long, gone long, before long, temp long, waiting boolean", "ts_us long, ambient_temp int", idle)


class Trailing(InOrder):
    """The distribution of the trailing period at every reading: a ring of readings in list state, from whose old end readings are evicted, and
    their number by temperature in map state."""

    def __init__(self, period_us: int, idle_ms: int):
        super().__init__(self._turn, "size long", ["line_id", "ts_us", "temp", "n", "is_full"], idle_ms)
        self.period_us = period_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ring = handle.getListState("ring", "ts_us long, temp int")
        self.counts = handle.getMapState("counts", "temp int", "n long")
        self.begun = handle.getValueState("begun", "ts_us long")

    def _turn(self, memory: tuple | None, rows: list[Row]) -> tuple[tuple, Iterator[tuple]]:
        if memory is None:  # the boot's first rows, or its first after an idle time
            for state in (self.ring, self.counts, self.begun):
                state.clear()
        kept = [tuple(r) for r in self.ring.get()] if self.ring.exists() else []
        counts = {k[0]: v[0] for k, v in self.counts.iterator()} if self.counts.exists() else {}
        begun = self.begun.get()[0] if self.begun.exists() else rows[0][0]
        readings = [*kept, *((r[0], r[4]) for r in rows)]
        ring = readings[bisect_left(readings, (rows[-1][0] - self.period_us,)):]
        after = Counter(temp for _, temp in ring)
        for t in {*counts, *after}:
            if after[t]:
                if after[t] != counts.get(t):
                    self.counts.updateValue((t,), (after[t],))
            elif self.counts.containsKey((t,)):
                self.counts.removeKey((t,))
        self.ring.put(ring)
        self.begun.update((begun,))
        return (len(ring),), self._histograms(readings, len(kept), [r[2] for r in rows], begun)

    def _histograms(self, readings: list[tuple], kept: int, lines: list[int], begun: int) -> Iterator[tuple]:
        """Per reading behind those that were kept: its line and time, the temperatures and their numbers, and whether the period is full."""
        times = np.array([t for t, _ in readings], np.int64)
        kinds, code = np.unique(np.array([x for _, x in readings], np.int64), return_inverse=True)
        counts = np.bincount(code[:kept], minlength=len(kinds))
        at, oldest = kept, 0
        while at < len(times):
            upto = int(np.searchsorted(times, times[at], "right"))  # readings of one time see each other
            first = max(int(np.searchsorted(times, times[at] - self.period_us)), oldest)
            np.add.at(counts, code[at:upto], 1)
            np.subtract.at(counts, code[oldest:first], 1)
            oldest, held = first, np.flatnonzero(counts)
            for k in range(at, upto):
                yield lines[k - kept], int(times[at]), kinds[held], counts[held], bool(times[at] - begun > self.period_us)
            at = upto

    def _frames(self, key: tuple, out: Iterable[tuple]) -> Iterator[pd.DataFrame]:
        part, size = [], 0
        for r in out:
            part.append(r)
            size += len(r[2])
            if size >= ROWS:
                yield self._frame(key, part)
                part, size = [], 0
        yield self._frame(key, part)

    def _frame(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        if not out:
            return super()._frame(key, out)
        lines, times, temps, counts, full = zip(*out)
        sizes = [len(t) for t in temps]
        long = lambda x: np.repeat(np.array(x), sizes)
        made = {"line_id": long(lines), "ts_us": long(times), "temp": np.concatenate(temps).astype(np.int32), "n": np.concatenate(counts), "is_full": long(full)}
        return pd.DataFrame({"device_id": [key[0]] * len(made["temp"]), "boot_id": [key[1]] * len(made["temp"]), **made})

    def _advance(self, key: tuple, fresh: list[Row], watermark_ms: int) -> Iterable[tuple]:
        out = super()._advance(key, fresh, watermark_ms)
        if not self.memory.exists() and self.begun.exists():
            for state in (self.ring, self.counts, self.begun):
                state.clear()
        return out


def trailing_at_readings(temps: DataFrame, period_us: int = 24 * 3_600_000_000, watermark: str = WATERMARK, idle: str = IDLE) -> DataFrame:
    """Per reading (line_id) the histogram temp, n of the readings in the period up to it, and whether the boot began more than a period before."""
    timed = _timed(temps, watermark, "temp is not null", ("pm",))
    processor = Trailing(period_us, int(pd.Timedelta(idle).total_seconds() * 1000))
    return timed.groupBy("device_id", "boot_id").transformWithStateInPandas(processor, f"{_KEY}, line_id long, ts_us long, temp int, n long, is_full boolean", "Append", "EventTime")


class Closing(InOrder):
    """Alarms with the readings of their windows. Readings wait in a ring of list state as long as an alarm can need them, and alarms in another
    list until the first reading after their window closes them."""

    #: What is given of a closed alarm's readings.
    given = _CLOSED
    row = {"ts_us": "long", "side": "int", "alarm_key": "string", "temp": "int", "when_rtc_us": "long", "max_when_us": "long", "late_us": "long", "window_length_ms": "long"}

    def __init__(self, reach_us: int, period_us: int, start_us: int, trigger_us: int, idle_ms: int):
        super().__init__(self._turn, "begun long", [c.split()[0] for c in self.given.split(", ")], idle_ms)
        self.reach_us, self.period_us, self.start_us, self.trigger_us = reach_us, period_us, start_us, trigger_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ring = handle.getListState("ring", "ts_us long, temp int")
        self.open = handle.getListState("open", _ALARM)

    def _turn(self, memory: tuple | None, rows: list[Row]) -> tuple[tuple, list[tuple]]:
        if memory is None:
            self._forget()
        begun = memory[0] if memory else None
        times, temps = map(list, zip(*self.ring.get())) if self.ring.exists() else ([], [])
        waits = [(max(a[0], a[3]), *a) for a in map(tuple, self.open.get())] if self.open.exists() else []
        heapq.heapify(waits)  # by the ends of the windows
        out = []
        for ts_us, side, alarm_key, temp, when, until, late, length in rows:
            if side == 0:
                begun = ts_us if begun is None else begun
                times.append(ts_us)
                temps.append(temp)
                while waits and waits[0][0] < ts_us:
                    out += self._close(heapq.heappop(waits)[1:], ts_us, begun, times, temps)
            elif length and ts_us - min(when, when + late) > self.reach_us:
                out.append((alarm_key, length, None, None, None, slice(0, 0)))
            elif length:
                heapq.heappush(waits, (max(ts_us, until), ts_us, alarm_key, when, until, late, length))
        needed = min([rows[-1][0] - self.reach_us, *(min(a[3], a[3] + a[5]) for a in waits)]) - max(self.start_us, self.trigger_us)
        first = bisect_left(times, needed)
        for state, held in ((self.ring, list(zip(times[first:], temps[first:]))), (self.open, [a[1:] for a in waits])):
            if held:
                state.put(held)
            else:
                state.clear()
        return (begun,), self._with_readings(out, times, temps)

    @staticmethod
    def _with_readings(out: list[tuple], times: list[int], temps: list[int]) -> Iterator[tuple]:
        """Slices as lists, made one by one."""
        for *alarm, within in out:
            yield (*alarm, times[within], temps[within])

    def _frames(self, key: tuple, out: Iterable[tuple]) -> Iterator[pd.DataFrame]:
        part, size = [], 0
        for r in out:
            part.append(r)
            size += 1 + sum(len(c) for c in r if isinstance(c, list))
            if size >= ROWS:
                yield self._frame(key, part)
                part, size = [], 0
        yield self._frame(key, part)

    def _close(self, alarm: tuple, close: int, begun: int, times: list[int], temps: list[int]) -> list[tuple]:
        ts_us, alarm_key, when, until, late, length = alarm
        if ts_us - begun <= self.period_us:
            return []
        start, trigger = self._nearest(times, when), self._nearest(times, when + late)
        if abs(times[start] - when) > self.start_us or abs(times[trigger] - when - late) > self.trigger_us:
            return []
        within = slice(start, max(bisect_left(times, until), start))
        while within.start and times[within.start - 1] == times[start]:  # all readings of the start's time
            within = slice(within.start - 1, within.stop)
        return [(alarm_key, length, close, times[start], temps[trigger], within)]

    @staticmethod
    def _nearest(times: list[int], t: int) -> int:
        """The place of the nearest reading up to now; of equally near ones the earlier."""
        ahead = bisect_right(times, t)
        if ahead == len(times) or ahead and t - times[ahead - 1] <= times[ahead] - t:
            return ahead - 1
        return ahead

    def _advance(self, key: tuple, fresh: list[Row], watermark_ms: int) -> Iterable[tuple]:
        out = super()._advance(key, fresh, watermark_ms)
        if self.memory.exists() or not (self.ring.exists() or self.open.exists()):
            return out
        never = [(a[1], a[5], None, None, None, slice(0, 0)) for a in self.open.get()] if self.open.exists() else []
        self._forget()
        return chain(out, self._with_readings(never, [], []))

    def _forget(self) -> None:
        self.ring.clear()
        self.open.clear()

    def _frame(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        return super()._frame(key, out).astype(object)


class Summing(Closing):
    """Of the readings only their number, the lowest and the last temperature are given."""

    given = _SUMMED

    @staticmethod
    def _with_readings(out: list[tuple], times: list[int], temps: list[int]) -> Iterator[tuple]:
        values = np.array(temps, np.int64)
        for *alarm, within in out:
            held = values[within]
            yield (*alarm, len(held), int(held.min()), max(temps[bisect_left(times, times[within.stop - 1]):within.stop])) if len(held) else (*alarm, 0, None, None)


def alarm_temps(alarms: DataFrame, temps: DataFrame, start_tolerance_us: int = 3_000_000, trigger_tolerance_us: int = 2_000_000, period_us: int = 24 * HOUR_US, reach_us: int = 26 * HOUR_US, watermark: str = WATERMARK, idle: str = IDLE) -> DataFrame:
    """Per closed alarm its close_us, start_ts, trigger_temp and readings, as the batch plan of this name closes them at the window's end; for streams.

    An alarm is given when the watermark passes the reading that closes it. One that none closes before its boot has been idle, or that comes
    later than ``reach_us`` after the start of its window, is given with these columns null and no readings. Alarms whose window has no readings
    have none either.
    """
    found = _closed(Closing, alarms, temps, (reach_us, period_us, start_tolerance_us, trigger_tolerance_us), watermark, idle)
    return found.withColumn("readings", F.arrays_zip(F.col("times").alias("ts_us"), F.col("temps").alias("temp"))).drop("times", "temps")


def alarm_summary(alarms: DataFrame, temps: DataFrame, start_tolerance_us: int = 3_000_000, trigger_tolerance_us: int = 2_000_000, period_us: int = 24 * HOUR_US, reach_us: int = 26 * HOUR_US, watermark: str = WATERMARK, idle: str = IDLE) -> DataFrame:
    """As alarm_temps, with the number of readings, min_temp and last_temp instead of the readings, which many alarms of a time share."""
    return _closed(Summing, alarms, temps, (reach_us, period_us, start_tolerance_us, trigger_tolerance_us), watermark, idle)


def _closed(kind: type[Closing], alarms: DataFrame, temps: DataFrame, bounds: tuple[int, ...], watermark: str, idle: str) -> DataFrame:
    columns = lambda d, **made: d.select("device_id", "boot_id", "ts", *[made.get(c, F.col(c) if c in d.columns else F.lit(None)).cast(t).alias(c) for c, t in Closing.row.items()])
    rows = columns(temps, side=F.lit(0), alarm_key=F.lit(""), when_rtc_us=F.lit(0), max_when_us=F.lit(0), late_us=F.lit(0), window_length_ms=F.lit(0)).unionByName(columns(alarms, side=F.lit(1), temp=F.lit(0)))
    processor = kind(*bounds, int(pd.Timedelta(idle).total_seconds() * 1000))
    return rows.withWatermark("ts", watermark).groupBy("device_id", "boot_id").transformWithStateInPandas(processor, f"{_KEY}, {kind.given}", "Append", "EventTime")
