"""Alarms and the temperatures of their windows.

alarms: device_id, boot_id, alarm_key, ts_us (delivery), window_length_ms, when_rtc_us, max_when_us, late_us (delivery after the start of the window);
temps: device_id, boot_id, ts_us, temp.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.algorithms import Algorithm, registry
from ..operators.distribution import HOUR_US as _HOUR
from ..operators.distribution import PERIOD_US
from ..operators.timeops import KEYS, first, following, last, running, written
from ..operators.windows import CHUNK_US, MISSING, Readings, column, lists, optional, parts, read_windows

SECOND = 1_000_000


def closed_alarms(alarms: DataFrame, temps: DataFrame, start_tolerance_us: int | Column = 3 * SECOND, trigger_tolerance_us: int = 2 * SECOND, period_us: int = PERIOD_US, close_at: str = "window_end", keys=KEYS, slices: Column | None = None) -> DataFrame:
    """Alarms with a window whose distribution is full at delivery and that a later reading closes, with start_ts, trigger_temp and close_us.

    They close at the first reading after the window's end, or (``close_at="first_reading"``) after delivery; readings behind that are unknown.
    ``slices`` is a number over _t.
    """
    end = F.greatest("ts_us", "max_when_us") if close_at == "window_end" else F.col("ts_us")
    times = {"close": end, "start": F.col("when_rtc_us"), "trigger": F.col("when_rtc_us") + F.col("late_us")}
    probe = F.explode(F.array(*[F.struct(F.lit(k).alias("what"), t.alias("t")) for k, t in times.items()]))
    probes = alarms.where("window_length_ms <> 0").withColumn("_probe", probe).withColumns({"_t": F.col("_probe.t"), "_side": F.lit(1)})
    readings = temps.select(*keys, F.col("ts_us").alias("_t"), F.lit(0).alias("_side"), F.struct(F.col("ts_us").alias("t"), F.col("temp").alias("v")).alias("_p"))
    union = probes.unionByName(readings, allowMissingColumns=True)
    specs = {"_first": first(F.col("_p.t")), "_back": last(F.col("_p")), "_ahead": following(F.col("_p"))}
    seen = running(union, specs, keys, ("_t", "_side"), slices).where("_probe is not null")  # all look-ups in one shuffle
    of = lambda what, c: F.max(F.when(F.col("_probe.what") == what, F.col(c)))
    found = [of(w, c).alias(f"_{w}{c}") for w in times for c in ("_t", "_first", "_back", "_ahead")]
    more = [c for c in alarms.columns if c not in (*keys, "alarm_key")]
    rows = seen.groupBy(*keys, "alarm_key").agg(*[F.first(c).alias(c) for c in more], *found).withColumn("close_us", F.col("_close_ahead.t"))
    rows = rows.where((F.col("ts_us") - F.col("_close_first") > period_us) & F.col("close_us").isNotNull())

    def nearest(what: str) -> tuple[Column, Column]:
        """The nearest reading, and how far it is; of equally near ones the earlier."""
        t, back = F.col(f"_{what}_t"), F.col(f"_{what}_back")
        ahead = F.when(F.col(f"_{what}_ahead.t") <= F.col("close_us"), F.col(f"_{what}_ahead"))
        near = F.when(ahead.isNull() | (t - back["t"] <= ahead["t"] - t), back).otherwise(ahead)
        return near, F.abs(near["t"] - t)

    (start, start_delta), (trigger, trigger_delta) = nearest("start"), nearest("trigger")
    kept = rows.where((start_delta <= start_tolerance_us) & (trigger_delta <= trigger_tolerance_us))
    return kept.select(*alarms.columns, "close_us", start["t"].alias("start_ts"), trigger["v"].alias("trigger_temp"))


def _windows(alarms: DataFrame, temps: DataFrame, columns: tuple[str, ...], keys, **tolerances) -> DataFrame:
    """Closed alarms with these columns and the last microsecond of their readings; written, as windows are read twice."""
    closed = closed_alarms(alarms, temps, keys=keys, **tolerances).withColumn("_end", F.least(F.col("max_when_us") - 1, "close_us"))
    return written(closed.select(*keys, "alarm_key", *(columns or [c for c in closed.columns if c not in (*keys, "alarm_key", "ts_us", "_end")]), "_end"))


def alarm_temps(alarms: DataFrame, temps: DataFrame, bucket_us: int = _HOUR, keys=KEYS, **tolerances) -> DataFrame:
    """Per closed alarm its readings from the start to the window's end, as an array in time order.

    The arrays are cut where they are given out. ``alarm_summary``, ``alarm_percents`` and ``evaluate_algorithms`` don't make them.
    """
    kind = temps.schema["temp"].dataType.simpleString()

    def read(windows: pa.Table, seen: Readings) -> Iterator[tuple[int, int, list[pa.Array]]]:
        low, high = seen.places(column(windows, "start_ts"), column(windows, "_end"))
        for k, end in parts(high - low):
            offsets, places = lists(low, high, k, end)
            yield k, end, [pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(seen.times[places]), optional(seen.temps[places])], ["ts_us", "temp"]))]

    rows = read_windows(_windows(alarms, temps, (), keys, **tolerances), temps, "start_ts", "_end", read, "readings array<struct<ts_us:long,temp:int>>", chunk_us=max(bucket_us, CHUNK_US), keys=keys)
    return rows.where(F.size("readings") > 0).withColumn("readings", F.col("readings").cast(f"array<struct<ts_us:bigint,temp:{kind}>>")).drop("_end")


def alarm_summary(alarms: DataFrame, temps: DataFrame, keys=KEYS, **tolerances) -> DataFrame:
    """Per closed alarm: trigger_temp, the number of its readings, min_temp and last_temp."""

    def read(windows: pa.Table, seen: Readings) -> Iterator[tuple[int, int, list[pa.Array]]]:
        low, high = seen.places(column(windows, "start_ts"), column(windows, "_end"))
        held = [seen.known(a, b) for a, b in zip(low.tolist(), high.tolist())]
        ends = [[int(f(x)) if len(x) else None for x in held] for f in (np.min, lambda x: x[-1])]
        yield 0, len(windows), [pa.array((high - low).astype(np.int64)), *(pa.array(x, pa.int32()) for x in ends)]

    rows = read_windows(_windows(alarms, temps, ("start_ts", "trigger_temp"), keys, **tolerances), temps, "start_ts", "_end", read, "readings long, min_temp int, last_temp int", keys=keys)
    return rows.where("readings > 0").drop("start_ts", "_end")


def alarm_percents(alarms: DataFrame, temps: DataFrame, keys=KEYS, **tolerances) -> DataFrame:
    """Per closed alarm and whole percent of its window that has readings: their number n and min_temp. As the table function window_readings."""

    def steps(times: np.ndarray, when: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """The percents that have readings, and where each begins."""
        first, last = (int((t - when) * 100 // window) for t in (int(times[0]), int(times[-1])))
        if window > 0 and last - first < len(times):
            bounds = np.arange(first, last + 1)
            begin = np.searchsorted(times, when - (-bounds * window // 100))
            kept = np.diff(begin, append=len(times)) > 0
            return bounds[kept], begin[kept]
        percent = (times - when) * 100 // window
        begin = np.flatnonzero(np.diff(percent, prepend=percent[0] - 1))
        return percent[begin], begin

    def read(windows: pa.Table, seen: Readings) -> Iterator[tuple[int, int, list[pa.Array]]]:
        when, length, start = (column(windows, c) for c in ("when_rtc_us", "window_length_ms", "start_ts"))
        low, high = seen.places(np.maximum(start, when), column(windows, "_end"))
        found, sizes = [], []
        for a, b, t, w in zip(low.tolist(), high.tolist(), when.tolist(), length.tolist()):
            if b > a:
                percent, begin = steps(seen.times[a:b], t, w * 1000)
                found.append((percent, np.diff(begin, append=b - a), np.minimum.reduceat(seen.temps[a:b], begin)))
            sizes.append(len(found[-1][0]) if b > a else 0)
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        columns = [np.concatenate(c).astype(np.int32) for c in zip(*found)] or [np.empty(0, np.int32)] * 3
        yield 0, len(windows), [pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(columns[0]), pa.array(columns[1]), optional(columns[2])], ["percent", "n", "min_temp"]))]

    rows = read_windows(_windows(alarms, temps, ("when_rtc_us", "window_length_ms", "start_ts"), keys, **tolerances), temps, "start_ts", "_end", read, "_steps array<struct<percent:int,n:int,min_temp:int>>", keys=keys)
    return rows.select(*keys, "alarm_key", F.inline("_steps"))


def alarm_trigger_temp(alarms: DataFrame, temps: DataFrame, share: float = 0.8, trigger_tolerance_us: int = 2 * SECOND, keys=KEYS, **more) -> DataFrame:
    """Per closed alarm its trigger temperature; the start may lie a share of the window away."""
    near = (F.col("window_length_ms") * 1000 * share).cast("long")
    return closed_alarms(alarms, temps, near, trigger_tolerance_us, keys=keys, **more).select(*keys, "alarm_key", "trigger_temp")


def percentile_array(histogram: DataFrame, by: list[str]) -> DataFrame:
    """by, percentiles: the nearest-rank temperatures of 0 to 100 percent."""
    group = Window.partitionBy(*by)
    upto = F.sum("n").over(group.orderBy("temp"))
    counted = histogram.withColumns({"_upto": upto, "_before": upto - F.col("n"), "_size": F.sum("n").over(group)})
    share = lambda c: F.floor(F.col(c) * 100 / F.col("_size"))
    times = share("_upto") - share("_before") + F.when(F.col("_before") == 0, 1).otherwise(0)  # so many percentiles name this temperature
    runs = counted.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("temp", times.cast("int").alias("times")))).alias("_runs"))
    return runs.select(*by, F.flatten(F.transform("_runs", lambda r: F.array_repeat(r["temp"], r["times"]))).alias("percentiles"))


def evaluate_algorithms(alarms: DataFrame, temps: DataFrame, least_window_ms: int = 3_600_000, min_readings: int = 100, algorithms: dict[str, Algorithm] | None = None, period_us: int = PERIOD_US, keys=KEYS, bucket_us: int = _HOUR, **more) -> DataFrame:
    """Per alarm with a long window and more than min_readings readings: what temperature each algorithm picks.

    Algorithms with ``pick`` see slices of the stream's readings. For others arrays are made where the slices are, and aren't shuffled.
    """
    named = algorithms or registry()
    picks = {name: build.pick for name, build in named.items() if hasattr(build, "pick")}
    built = {name: build for name, build in named.items() if name not in picks}
    arrays = bool(built)

    def read(windows: pa.Table, seen: Readings) -> Iterator[tuple[int, int, list[pa.Array]]]:
        when, length, start, close, trigger = (column(windows, c) for c in ("when_rtc_us", "window_length_ms", "start_ts", "close_us", "trigger_temp"))
        low, high = seen.places(start, column(windows, "_end"))
        before, upto = seen.places(close - period_us, close)
        for k, end in parts(high - low if arrays else np.zeros(len(low), np.int64)):
            found, tables, whole = [], [], np.arange(101)
            for i in range(k, end):
                a, b = int(low[i]), int(high[i])
                table = seen.percentiles(int(before[i]), int(upto[i]), whole) if b - a > min_readings else None
                tables.append(table)
                if table is not None:
                    times = seen.times[a:b][seen.temps[a:b] != MISSING] if seen.misses else seen.times[a:b]
                    found.append([pick(times, seen.known(a, b), int(when[i]), int(length[i]) * 1000, table, None if trigger[i] == MISSING else int(trigger[i])) for pick in picks.values()])
                else:
                    found.append(None)
            columns = [pa.array(found, pa.list_(pa.int32()))]
            if arrays:
                offsets, places = lists(low, high, k, end)
                columns.append(pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(seen.times[places]), optional(seen.temps[places])], ["ts_us", "temp"])))
                columns.append(pa.array([None if t is None else t.tolist() for t in tables], pa.list_(pa.int32())))
            yield k, end, columns

    out = "_picks array<int>" + (", readings array<struct<ts_us:long,temp:int>>, percentiles array<int>" if arrays else "")
    names = ("when_rtc_us", "window_length_ms", "start_ts", "close_us", "trigger_temp")
    windows = _windows(alarms.where(F.col("window_length_ms") >= least_window_ms), temps, names, keys, period_us=period_us, **more)
    rows = read_windows(windows, temps, F.least("start_ts", F.col("close_us") - period_us), "close_us", read, out, chunk_us=max(bucket_us, CHUNK_US), keys=keys)
    full = rows.where("_picks is not null").withColumn("window_us", F.col("window_length_ms") * 1000)
    taken = {name: F.get("_picks", F.lit(k)) for k, name in enumerate(picks)} | {name: build().cast("int") for name, build in built.items()}
    picked = F.explode(F.array(*[F.struct(F.lit(name).alias("algorithm"), taken[name].alias("temp")) for name in named]))
    return full.select(*keys, "alarm_key", "window_length_ms", picked.alias("_p")).select(*keys, "alarm_key", "window_length_ms", "_p.*")


def algorithm_results(evaluated: DataFrame) -> DataFrame:
    """Per device and algorithm: alarms and mean, lowest and highest temperature."""
    return evaluated.groupBy("device_id", "algorithm").agg(F.count("*").alias("alarms"), F.round(F.avg("temp"), 6).alias("avg_temp"), F.min("temp").alias("min_temp"), F.max("temp").alias("max_temp"))


#: What a set alarm and its delivery have in common.
MATCH = ("pid", "uid", "flags", "window_length_ms", "type", "creator_pkg", "target_pkg")


def match_set_alarms(set_alarms: DataFrame, alarms: DataFrame, on=MATCH, keys=KEYS) -> DataFrame:
    """Pairs of set and delivered alarms of a boot that agree in all seven fields; missing packages agree."""
    test = F.lit(True)
    for c in (*keys, *on):
        test = test & F.col(f"s.{c}").eqNullSafe(F.col(f"a.{c}"))
    return set_alarms.alias("s").join(alarms.alias("a"), test).select(*[f"s.{c}" for c in keys], F.col("s.line_id").alias("set_line"), F.col("a.line_id").alias("delivered_line"))
