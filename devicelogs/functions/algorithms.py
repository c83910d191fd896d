"""Deferral algorithms as column expressions.

An algorithm sees when_rtc_us, window_us, trigger_temp, readings (an array of structs ts_us, temp in time order) and percentiles (the
nearest-rank temperatures of the percentiles 0 to 100) and names a temperature. User algorithms are builders of the same kind; ``vectorized``
makes one of a function over whole Arrow batches. A builder with ``pick`` has the same algorithm in numpy: where the readings of a window are a
slice of a stream's, it takes the slice, and no array of them is made.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Algorithm = Callable[[], Column]
#: Of one alarm: times and temperatures of its readings, start and length of its window, the percentiles, the temperature at delivery.
Pick = Callable[[np.ndarray, np.ndarray, int, int, np.ndarray, int], int | None]


def _readings() -> Column:
    return F.filter("readings", lambda r: r["ts_us"] >= F.col("when_rtc_us"))


def _percent(r: Column) -> Column:
    """How much of the window has passed."""
    return (r["ts_us"] - F.col("when_rtc_us")) * 100 / F.col("window_us")


def _first_or_last(fits: Callable[[Column], Column]) -> Column:
    hit = F.get(F.filter(_readings(), fits), F.lit(0))["temp"]
    return F.coalesce(hit, F.try_element_at("readings", F.lit(-1))["temp"])


def _picks(build: Algorithm, pick: Pick) -> Algorithm:
    build.pick = pick
    return build


def _first(n: int, fits: Callable[[int, int], np.ndarray]) -> int | None:
    """The first place of n for which fits(low, high) holds, looked for in steps that grow."""
    at, step = 0, 256
    while at < n:
        hits = fits(at, min(at + step, n))
        k = int(hits.argmax())
        if hits[k]:
            return at + k
        at, step = at + step, step * 4
    return None


def _last(temps: np.ndarray) -> int | None:
    return int(temps[-1]) if len(temps) else None


def linear_threshold(base: int = 25) -> Algorithm:
    """The first temperature at or below a percentile that rises from base to 100 over the window."""
    if base <= 0:
        raise ValueError("the base must be above 0")

    def pick(times: np.ndarray, temps: np.ndarray, when: int, window: int, percentiles: np.ndarray, trigger: int) -> int | None:
        begin = int(np.searchsorted(times, when))
        since, inside = times[begin:], temps[begin:]

        def fits(low: int, high: int) -> np.ndarray:
            rank = np.minimum(np.floor(base + (since[low:high] - when) * 100 / window * (100 - base) / 100), 100).astype(np.int64)
            return inside[low:high] <= percentiles[rank]

        at = _first(len(inside), fits)
        return _last(temps) if at is None else int(inside[at])

    def build() -> Column:
        rank = lambda r: F.least(F.floor(F.lit(base) + _percent(r) * (100 - base) / 100), F.lit(100)).cast("int")
        return _first_or_last(lambda r: r["temp"] <= F.get("percentiles", rank(r)))

    return _picks(build, pick)


def _stop(percent: Callable[[int], float]) -> Pick:
    """stopping in numpy; percent is the limit for a number of readings."""

    def pick(times: np.ndarray, temps: np.ndarray, when: int, window: int, percentiles: np.ndarray, trigger: int) -> int | None:
        limit, begin = percent(len(temps)), int(np.searchsorted(times, when))
        seen = bisect_left(range(begin, len(times)), True, key=lambda k: not (int(times[k]) - when) * 100 / window < limit) + begin
        best = min(100_000, int(temps[begin:seen].min())) if seen > begin else 100_000
        after = temps[seen:]
        at = _first(len(after), lambda low, high: after[low:high] < best)
        return _last(temps) if at is None else int(after[at])

    return pick


def stopping(limit: Column | None = None) -> Algorithm:
    """Watches the first part of the window (1/e of it, or limit percent), then takes the first temperature below all it saw."""

    def build() -> Column:
        bound = F.lit(100 / math.e) if limit is None else limit
        start = F.struct(F.lit(100_000).alias("best"), F.lit(None).cast("int").alias("pick"))

        def step(state: Column, r: Column) -> Column:
            watching = _percent(r) < bound
            best = F.when(watching, F.least(state["best"], r["temp"])).otherwise(state["best"])
            pick = F.coalesce(state["pick"], F.when(~watching & (r["temp"] < state["best"]), r["temp"]))
            return F.struct(best.alias("best"), pick.alias("pick"))

        picked = F.aggregate(_readings(), start, step)["pick"]  # one pass in time order
        return F.coalesce(picked, F.try_element_at("readings", F.lit(-1))["temp"])

    return _picks(build, _stop(lambda n: 100 / math.e)) if limit is None else build


def cardinal_stopping() -> Algorithm:
    """As stopping, with the square root of the number of readings as the percentage."""
    return _picks(stopping(F.ceil(F.sqrt(F.size("readings")))), _stop(lambda n: math.ceil(math.sqrt(n))))


def oracle() -> Column:
    """The lowest temperature of all."""
    return F.least(F.col("trigger_temp"), F.array_min(F.transform("readings", lambda r: r["temp"])))


def android() -> Column:
    """The temperature at delivery."""
    return F.col("trigger_temp")


_picks(oracle, lambda times, temps, when, window, percentiles, trigger: min(int(temps.min()), int(temps.min()) if trigger is None else trigger) if len(temps) else trigger)
_picks(android, lambda times, temps, when, window, percentiles, trigger: trigger)


def registry(base: int = 25) -> dict[str, Algorithm]:
    return {f"simple-linear-threshold-{base}": linear_threshold(base), "optimal-stopping": stopping(), "optimal-stopping-cardinal": cardinal_stopping(), "oracle": oracle, "android": android}


# Algorithms in Python


def vectorized(pick: Pick) -> Algorithm:
    """An algorithm in numpy. Readings reach it as two arrays, batch by batch, so there is one call into Python per Arrow batch and not per reading."""

    def batch(times: pd.Series, temps: pd.Series, when: pd.Series, window: pd.Series, percentiles: pd.Series, trigger: pd.Series) -> pd.Series:
        return pd.Series([pick(*alarm) for alarm in zip(times, temps, when, window, percentiles, trigger, strict=True)], dtype="Int32")

    udf = F.pandas_udf(batch, "int")
    field = lambda name: F.transform("readings", lambda r: r[name])
    return _picks(lambda: udf(field("ts_us"), field("temp"), F.col("when_rtc_us"), F.col("window_us"), F.col("percentiles"), F.col("trigger_temp")), pick)


def steepest_fall() -> Algorithm:
    """The reading after the steepest fall between neighbour readings of the window (the first of equal ones); the last reading if it never falls."""

    def pick(times: np.ndarray, temps: np.ndarray, when: int, window: int, percentiles: np.ndarray, trigger: int) -> int | None:
        inside = temps[times >= when]
        if not len(inside):
            return int(temps[-1]) if len(temps) else None
        falls = -np.diff(inside)
        return int(inside[int(falls.argmax()) + 1]) if len(falls) and falls.max() > 0 else int(inside[-1])

    return vectorized(pick)


class WindowReadings:
    """A table function: of each whole percent of the window that has readings the number of them and the lowest temperature."""

    def eval(self, times: list[int], temps: list[int], when_rtc_us: int, window_us: int) -> Iterator[tuple[int, int, int]]:
        steps: dict[int, list[int]] = {}
        for t, temp in zip(times or [], temps or [], strict=True):
            if window_us and t >= when_rtc_us:
                steps.setdefault((t - when_rtc_us) * 100 // window_us, []).append(temp)
        for percent, seen in sorted(steps.items()):
            yield percent, len(seen), min(seen)


def register_functions(spark: SparkSession) -> None:
    """window_readings(times, temps, when_rtc_us, window_us) for SQL."""
    spark.udtf.register("window_readings", F.udtf(WindowReadings, returnType="percent int, n int, min_temp int", useArrow=True))


def readings_by_percent(alarms: DataFrame) -> DataFrame:
    """percent, n and min_temp of the readings of each alarm (alarm_key, readings, when_rtc_us, window_length_ms)."""
    register_functions(alarms.sparkSession)
    sql = """SELECT a.alarm_key, w.* FROM {alarms} a,
    LATERAL window_readings(transform(a.readings, r -> r.ts_us), transform(a.readings, r -> r.temp), a.when_rtc_us, a.window_length_ms * 1000) w"""
    return alarms.sparkSession.sql(sql, alarms=alarms)
