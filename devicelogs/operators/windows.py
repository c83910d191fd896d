"""Windows over a stream's readings, read as slices of sorted arrays.

Windows that overlap hold the same readings many times; joined and gathered they would be shuffled as often. Here windows and readings are dealt
out by stream and chunk of time, a reading to each chunk that has a window over it, and a task sees the readings of a chunk once: a window is a
slice of them. What is shuffled and held grows with the readings and windows, and not with the pairs of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeops import DAY_US, KEYS, interval_join, written

#: Length of a chunk; windows should be shorter as a rule, as readings go to every chunk with a window over them.
CHUNK_US = 8 * DAY_US
#: Windows that are read at once, and readings in one batch of lists.
ROWS, VALUES = 2_000, 500_000
#: Stands for a missing temperature: behind all others.
MISSING = 2**31 - 1


class Readings:
    """The readings of a chunk in the order of time and temperature."""

    def __init__(self, times: np.ndarray, temps: np.ndarray):
        order = np.lexsort((temps, times))
        self.times, self.temps = times[order], temps[order]
        self.misses = bool((self.temps == MISSING).any())
        self._upto = None

    def known(self, low: int, high: int) -> np.ndarray:
        """The temperatures of a slice, without missing ones."""
        temps = self.temps[low:high]
        return temps[temps != MISSING] if self.misses else temps

    def places(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each window [start, end] the slice of its readings."""
        low = np.searchsorted(self.times, start, "left")
        return low, np.maximum(np.searchsorted(self.times, end, "right"), low)

    def _run(self) -> None:
        """Running counts of each temperature at every step-th reading; as many numbers as readings at most."""
        self.kinds, self.code = np.unique(self.temps, return_inverse=True)
        self.step = max(512, len(self.kinds))
        ends = range(0, len(self.temps) + 1, self.step)
        self._upto = np.zeros((len(ends), len(self.kinds)), np.int64)
        for k in range(1, len(ends)):
            self._upto[k] = self._upto[k - 1] + self._counts(ends[k - 1], ends[k])

    def _counts(self, low: int, high: int) -> np.ndarray:
        return np.bincount(self.code[low:high], minlength=len(self.kinds))

    def percentiles(self, low: int, high: int, p: np.ndarray) -> np.ndarray:
        """Nearest-rank temperatures of a slice that isn't empty."""
        if self._upto is None:
            self._run()
        first, end = low // self.step, high // self.step
        if first == end:
            counts = self._counts(low, high)
        else:
            counts = self._upto[end] - self._upto[first] + self._counts(end * self.step, high) - self._counts(first * self.step, low)
        ranks = np.maximum(((high - low) * p + 99) // 100, 1)
        return self.kinds[np.searchsorted(np.cumsum(counts), ranks)]


#: Of a table of windows and the readings: the columns to add, or parts of them by (first window, end).
Read = Callable[[pa.Table, Readings], Iterator[tuple[int, int, list[pa.Array]]]]


def column(windows: pa.Table, name: str) -> np.ndarray:
    """A column of numbers; missing ones count as MISSING."""
    return windows[name].fill_null(MISSING).to_numpy()


def lists(low: np.ndarray, high: np.ndarray, at: int, end: int) -> tuple[pa.Array, np.ndarray]:
    """Offsets of the slices at..end as lists, and the places of their values."""
    sizes = (high - low)[at:end]
    return pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), np.concatenate([np.arange(a, b) for a, b in zip(low[at:end], high[at:end])] or [np.arange(0)])


def parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of windows with about VALUES readings."""
    at, upto = 0, np.cumsum(sizes)
    while at < len(sizes):
        end = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + VALUES, "right")), at + 1)
        yield at, end
        at = end


def optional(temps: np.ndarray) -> pa.Array:
    return pa.array(temps, pa.int32(), mask=temps == MISSING)


def read_windows(windows: DataFrame, readings: DataFrame, start: str | Column, end: str | Column, read: Read, out: str, length_us: int | None = None, chunk_us: int = CHUNK_US, keys=KEYS, time: str = "ts_us", temp: str = "temp") -> DataFrame:
    """windows with the columns ``out`` that ``read`` finds in the readings of [start, end], and perhaps beyond.

    Windows are read twice, so a plan that is long should be ``written`` first. If all windows are at most ``length_us`` long they are read once.
    """
    begin, until = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    chunk = lambda t: F.floor(t / chunk_us)
    names, spans = windows.columns, windows.select(*keys, chunk(begin).alias("_chunk"), begin.alias("_from"), until.alias("_until"), F.struct(*windows.columns).alias("_window"))
    points = readings.select(*keys, F.col(time).alias("_t"), F.col(temp).cast("int").alias("_temp"))
    if length_us is None:
        reach = written(spans.where("_from <= _until").groupBy(*keys, "_chunk").agg(F.min("_from").alias("_from"), F.max("_until").alias("_until")))
        points = interval_join(reach, points, "_from", "_until", chunk_us, "_t", keys, closed=True).select(*keys, "_chunk", "_t", "_temp")
    else:
        points = points.withColumn("_chunk", F.explode(F.sequence(chunk(F.col("_t") - length_us), chunk(F.col("_t")))))
    both = spans.select(*keys, "_chunk", "_window").unionByName(points, allowMissingColumns=True)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in windows.schema)}, {out}"
    added = [part.strip().split()[0] for part in _columns(out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, times, temps = [], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for b in batches:
            is_reading, is_window = b["_t"].is_valid(), b["_window"].is_valid()
            times.append(b["_t"].filter(is_reading).to_numpy())
            temps.append(b["_temp"].filter(is_reading).fill_null(MISSING).to_numpy())
            held.append(pa.RecordBatch.from_struct_array(b["_window"].filter(is_window)))
        table, seen = pa.Table.from_batches(held), Readings(np.concatenate(times), np.concatenate(temps))
        del times, temps, held
        for at in range(0, len(table), ROWS):
            some = table.slice(at, ROWS)
            for low, high, found in read(some, seen):
                rows = some.slice(low, high - low).combine_chunks()
                yield from pa.Table.from_arrays([*(c.combine_chunks() for c in rows.columns), *found], [*names, *added]).to_batches()

    return both.groupBy(*keys, "_chunk").applyInArrow(run, schema)


def _columns(out: str) -> Iterator[str]:
    """The columns of a schema's text; commas within brackets divide none."""
    depth, at = 0, 0
    for i, c in enumerate(out):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            yield out[at:i]
            at = i + 1
    yield out[at:]
