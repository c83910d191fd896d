"""Temperature distributions: trailing windows, nearest-rank percentiles, probabilities and heating or cooling curves.

Readings are (device_id, boot_id, ts_us, temp); temperatures are few distinct integers, so histograms stay small.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeops import KEYS, interval_join, last, running, total
from .windows import MISSING, Readings, column, lists, optional, parts, read_windows

HOUR_US = 3_600_000_000
PERIOD_US = 24 * HOUR_US
#: Places in a block of running counts.
PLACES = 24


def trailing_is_full(temps: DataFrame, period_us: int = PERIOD_US, keys=KEYS) -> DataFrame:
    """temps with is_full: some reading so far lies more than the period after the stream's first."""
    first = temps.groupBy(*keys).agg(F.min("ts_us").alias("_first"))
    return temps.join(first, [*keys]).withColumn("is_full", F.col("ts_us") - F.col("_first") > period_us).drop("_first")


def running_counts(temps: DataFrame, place_us: int, keys=KEYS) -> DataFrame:
    """Per stream and _block of PLACES times place_us: _runs, of each temperature its running counts at the ends of the block's places.

    Counts start anew in each block, so blocks are built side by side and no stream is ordered as a whole.
    """
    number = F.floor(F.col("ts_us") / place_us)
    placed = temps.select(*keys, "temp", F.floor(number / PLACES).alias("_block"), F.pmod(number, F.lit(PLACES)).alias("_place"))
    upto = F.array(*[F.count_if(F.col("_place") <= k) for k in range(PLACES)])
    by_temp = placed.groupBy(*keys, "_block", "temp").agg(upto.alias("upto"))
    return by_temp.groupBy(*keys, "_block").agg(F.collect_list(F.struct("temp", "upto")).alias("_runs"))


def trailing_histogram(probes: DataFrame, temps: DataFrame, period_us: int = PERIOD_US, probe: str = "probe_id", at: str = "at_us", keys=KEYS) -> DataFrame:
    """probe, temp, n: readings in [at - period, at].

    Time is cut into places of a 24th of the period, and these into blocks as long as the period. The whole places of a window lie in two
    blocks at most: two look-ups of running counts. Only the places at the edges are read by single readings.
    """
    place_us = max(-(-period_us // PLACES), 1)
    bounds = probes.select(*keys, probe, F.col(at).alias("_to"), (F.col(at) - period_us).alias("_from"))
    bounds = bounds.withColumns({"_low": F.floor(F.col("_from") / place_us), "_high": F.floor(F.col("_to") / place_us)})
    start, end = F.col("_low") + 1, F.col("_high") - 1
    block, place = lambda h: F.floor(h / PLACES), lambda h: F.pmod(h, F.lit(PLACES)).cast("int")
    look = lambda b, before, upto: F.struct(b.alias("block"), before.alias("before"), upto.alias("upto"))
    one = F.array(look(block(start), place(start) - 1, place(end)))
    two = F.array(look(block(start), place(start) - 1, F.lit(PLACES - 1)), look(block(end), F.lit(-1), place(end)))
    looks = bounds.where(start <= end).withColumn("_look", F.explode(F.when(block(start) == block(end), one).otherwise(two)))
    looks = looks.select(*keys, probe, F.col("_look.block").alias("_block"), "_look.before", "_look.upto").repartition(*keys, "_block")
    runs = looks.join(running_counts(temps, place_us, keys), [*keys, "_block"]).select(*keys, probe, "before", "upto", F.explode("_runs").alias("_run"))
    n = F.get("_run.upto", F.col("upto")) - F.coalesce(F.get("_run.upto", F.col("before")), F.lit(0))
    whole = runs.select(*keys, probe, "_run.temp", n.alias("n")).where("n > 0")
    edges = bounds.withColumn("_number", F.explode(F.array_distinct(F.array("_low", "_high")))).repartition(*keys, "_number")
    readings = temps.select(*keys, "ts_us", "temp", F.floor(F.col("ts_us") / place_us).alias("_number"))
    single = edges.join(readings, [*keys, "_number"]).where("ts_us between _from and _to").groupBy(*keys, "_number", probe, "temp").agg(F.count("*").alias("n"))
    parts = whole.unionByName(single.drop("_number")).repartition(*keys, probe)  # also what percentiles are ordered by
    return parts.groupBy(*keys, probe, "temp").agg(F.sum("n").alias("n"))


def nearest_rank(histogram: DataFrame, percentiles: list[int], by: list[str], temp: str = "temp", n: str = "n") -> DataFrame:
    """Per group and percentile the smallest temperature whose cumulative count reaches ceil(size * p / 100); p = 0 gives the minimum.

    A temperature is the answer for a range of percentiles, which follows from the counts before and with it.
    """
    group = Window.partitionBy(*by)
    counted = histogram.where(F.col(n) > 0).withColumns({"_upto": F.sum(n).over(group.orderBy(temp)), "_size": F.sum(n).over(group)})
    share = lambda c: F.floor(c * 100 / F.col("_size")).cast("int")
    before = F.col("_upto") - F.col(n)
    ranges = counted.withColumns({"_least": F.when(before == 0, 0).otherwise(share(before) + 1), "_most": share(F.col("_upto"))}).where("_least <= _most")
    rows = ranges.select(*by, F.explode(F.sequence("_least", "_most")).alias("p"), F.col(temp).alias("percentile_temp"))
    return rows.where(F.col("p").isin(sorted(set(percentiles))))


def trailing_percentile(probes: DataFrame, temps: DataFrame, percentiles: list[int], period_us: int = PERIOD_US, probe: str = "probe_id", at: str = "at_us", keys=KEYS) -> DataFrame:
    """Percentiles of the trailing window at each probe. Windows over integers are read as slices; others go by their histograms."""
    if temps.schema["temp"].dataType.typeName() in ("byte", "short", "integer"):
        named = np.array(sorted(set(percentiles)), np.int64)

        def read(windows: pa.Table, seen: Readings) -> Iterator[tuple[int, int, list[pa.Array]]]:
            until = column(windows, at)
            low, high = seen.places(until - period_us, until)
            found = [seen.percentiles(a, b, named) if b > a else named[:0] for a, b in zip(low.tolist(), high.tolist())]
            ends = np.concatenate(([0], np.cumsum([len(f) for f in found])))
            yield 0, len(windows), [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), optional(np.concatenate(found).astype(np.int32)))]

        rows = read_windows(probes.select(*keys, probe, at), temps, F.col(at) - period_us, at, read, "_found array<int>", period_us, keys=keys)
        rows = rows.select(*keys, probe, F.posexplode("_found").alias("_k", "percentile_temp"))
        return rows.select(*keys, probe, F.get(F.array(*map(F.lit, named.tolist())), F.col("_k")).cast("int").alias("p"), F.col("percentile_temp").cast(temps.schema["temp"].dataType))
    return nearest_rank(trailing_histogram(probes, temps, period_us, probe, at, keys), percentiles, [*keys, probe])


OPERATORS = {"<": lambda t, x: t < x, "<=": lambda t, x: t <= x, "=": lambda t, x: t == x, ">=": lambda t, x: t >= x, ">": lambda t, x: t > x, "!=": lambda t, x: t != x}


def probability(temps: DataFrame, temp: int, op: str, keys=KEYS) -> DataFrame:
    """Share of each stream's readings that compare so with temp."""
    return temps.groupBy(*keys).agg(F.avg(OPERATORS[op](F.col("temp"), F.lit(temp)).cast("double")).alias("probability"))


def measured_duration(temps: DataFrame, keys=KEYS) -> DataFrame:
    """Seconds from the first to the last reading."""
    return temps.groupBy(*keys).agg(((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("duration_s"))


def idx_for_duration(temps: DataFrame, duration_us: int, period_us: int = PERIOD_US, keys=KEYS) -> DataFrame:
    """Index of the first reading at least so long after the stream's first; -1 without one or beyond the period."""
    first = temps.groupBy(*keys).agg(F.min("ts_us").alias("_first"))
    sides = temps.join(first, [*keys]).groupBy(*keys).agg(F.count_if(F.col("ts_us") - F.col("_first") < duration_us).alias("_before"), F.count("*").alias("_all"))
    found = F.when((F.lit(duration_us) > period_us) | (F.col("_before") == F.col("_all")), -1).otherwise(F.col("_before"))
    return sides.select(*keys, found.cast("long").alias("idx"))


def curve_class(temps: DataFrame, period_us: int, threshold: int, keys=KEYS, slices: Column | None = None) -> DataFrame:
    """temps with curve: the latest reading at least a period ago lies above (cooling), below (heating) or within the threshold (unknown)."""
    past = temps.select(*keys, (F.col("ts_us") + period_us).alias("ts_us"), F.struct("ts_us", "temp").alias("_start"), F.lit(0).alias("_side"), F.lit(True).alias("_past"))
    union = temps.withColumn("_side", F.lit(1)).unionByName(past, allowMissingColumns=True)
    seen = running(union, {"_from": last(F.col("_start"))}, keys, ("ts_us", "_side"), slices).where("_past is null")
    start = F.col("_from.temp")
    curve = F.when(start > F.col("temp") + threshold, "cooling").when(start < F.col("temp") - threshold, "heating").otherwise("unknown")
    return seen.withColumn("curve", curve).select(*temps.columns, "curve")


def first_curve(classed: DataFrame, keys=KEYS) -> DataFrame:
    """Per stream the earliest reading with a known curve; streams without one have no row."""
    point = F.struct("temp", "curve", "ts_us")
    return classed.where("curve <> 'unknown'").groupBy(*keys).agg(F.min_by(point, "ts_us").alias("p")).select(*keys, "p.*")


def curve_grid(spark, periods_s: list[int], top: int = 120, step: int = 5) -> DataFrame:
    """All (curve, temp_bucket, period_s): a small fixed grid."""
    buckets = F.explode(F.sequence(F.lit(0), F.lit(top - step), F.lit(step)))
    curves = F.explode(F.array(*[F.lit(c) for c in ("heating", "cooling", "unknown")]))
    rows = spark.range(1).select(buckets.alias("temp_bucket")).select("*", curves.alias("curve"))
    return rows.select("curve", "temp_bucket", F.explode(F.array(*[F.lit(p) for p in periods_s])).alias("period_s"))


def curve_probabilities(classed: DataFrame, periods_s: list[int], threshold: str = "threshold_temp", keys=KEYS, slices: Column | None = None) -> DataFrame:
    """curve, temp_bucket, period_s: seen later readings and those below the threshold temperature, summed over all readings.

    A later reading has a later time and comes in less than the period; readings of one microsecond don't see each other. Readings are counted
    once along the stream; each reading takes the count just before its periods' ends less the count at its own time. ``slices`` is a number
    over _at.
    """
    bucket = F.col("temp") - F.col("temp") % 5
    looks = [F.struct(F.lit(p).alias("p"), (F.col("ts_us") + max(p * 1_000_000 - 1, 0)).alias("at")) for p in (-1, 0, *periods_s)]
    rows = classed.select(*keys, "curve", bucket.alias("temp_bucket"), "ts_us", (F.col("temp") < F.col(threshold)).alias("_below"), F.explode(F.array(*looks)).alias("_l"))
    is_reading = F.col("_l.p") < 0
    weighed = rows.select(*keys, "curve", "temp_bucket", F.col("_l.p").alias("_p"), F.when(is_reading, F.col("ts_us")).otherwise(F.col("_l.at")).alias("_at"), (~is_reading).cast("int").alias("_side"), is_reading.cast("long").alias("_one"), (is_reading & F.col("_below")).cast("long").alias("_low"))
    counted = running(weighed, {"_seen": total(F.col("_one")), "_under": total(F.coalesce("_low", F.lit(0)))}, keys, ("_at", "_side"), slices).where("_p >= 0")
    sums = counted.groupBy("curve", "temp_bucket").agg(*[F.sum(F.when(F.col("_p") == p, F.col(c))).alias(f"{c}_{p}") for p in (0, *periods_s) for c in ("_seen", "_under")])
    parts = [F.struct(F.lit(p).alias("period_s"), (F.col(f"_seen_{p}") - F.col("_seen_0")).alias("seen"), (F.col(f"_under_{p}") - F.col("_under_0")).alias("below")) for p in periods_s]
    return sums.select("curve", "temp_bucket", F.explode(F.array(*parts)).alias("r")).select("curve", "temp_bucket", "r.*").where("seen > 0")


def curve_map(classed: DataFrame, periods_s: list[int], top: int = 120, threshold: str = "threshold_temp", keys=KEYS, slices: Column | None = None) -> DataFrame:
    """curve_probabilities on the whole grid: cells that no reading fell into have zeros, buckets from top on are left out."""
    grid = curve_grid(classed.sparkSession, periods_s, top)
    filled = grid.join(curve_probabilities(classed, periods_s, threshold, keys, slices), ["curve", "temp_bucket", "period_s"], "left")
    return filled.select("curve", "temp_bucket", "period_s", F.coalesce("seen", F.lit(0)).alias("seen"), F.coalesce("below", F.lit(0)).alias("below"))


def curve_accuracy(classed: DataFrame, periods_s: list[int], threshold: str = "threshold_temp", keys=KEYS) -> DataFrame:
    """From each stream's first known curve: per period, whether any later reading came within it, and whether one of them was below."""
    head = first_curve(classed, keys).withColumnRenamed("temp", "first_temp").withColumnRenamed("ts_us", "first_ts")
    limit = max(periods_s) * 1_000_000
    spans = head.withColumns({"_from": F.col("first_ts") + 1, "_until": F.col("first_ts") + limit}).select(*keys, "curve", "first_temp", "first_ts", "_from", "_until")
    later = interval_join(spans, classed.select(*keys, "ts_us", "temp", threshold), "_from", "_until", max(limit, HOUR_US))
    delta = F.col("ts_us") - F.col("first_ts")
    flags = [F.max(((delta < p * 1_000_000) & test).cast("int")).alias(f"{k}_{p}") for p in periods_s for k, test in (("seen", F.lit(True)), ("below", F.col("temp") < F.col(threshold)))]
    per_stream = later.groupBy(*keys, "curve", "first_temp").agg(*flags)
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("period_s"), F.col(f"seen_{p}").alias("seen"), F.col(f"below_{p}").alias("below")) for p in periods_s]))
    bucket = (F.col("first_temp") - F.col("first_temp") % 5).alias("temp_bucket")
    return per_stream.select("curve", bucket, rows.alias("r")).groupBy("curve", "temp_bucket", "r.period_s").agg(F.sum("r.seen").alias("seen"), F.sum("r.below").alias("below"))


def _with_full(rows: DataFrame, temps: DataFrame, period_us: int, keys) -> DataFrame:
    """rows (at_us) with is_full."""
    first = temps.groupBy(*keys).agg(F.min("ts_us").alias("_first"))
    return rows.join(first, [*keys]).withColumn("is_full", F.col("at_us") - F.col("_first") > period_us).drop("_first")


def distribution_snapshot(temps: DataFrame, at: DataFrame, period_us: int = PERIOD_US, keys=KEYS) -> DataFrame:
    """Per probe (probe_id, at_us): the trailing readings as sorted arrays, with period, is_full and num_entries.

    The arrays are cut where they are given out; where only their sums are asked for, ``distribution_sums`` doesn't make them.
    """

    def read(windows: pa.Table, seen: Readings) -> Iterator[tuple[int, int, list[pa.Array]]]:
        until = column(windows, "at_us")
        low, high = seen.places(until - period_us, until)
        for k, end in parts(high - low):
            offsets, places = lists(low, high, k, end)
            yield k, end, [pa.ListArray.from_arrays(offsets, pa.array(seen.times[places])), pa.ListArray.from_arrays(offsets, optional(seen.temps[places]))]

    rows = read_windows(at.select(*keys, "probe_id", "at_us"), temps, F.col("at_us") - period_us, "at_us", read, "_times array<long>, _temps array<int>", period_us, keys=keys)
    full = _with_full(rows.where(F.size("_times") > 0), temps, period_us, keys)
    return full.select(*keys, "probe_id", F.col("_times").alias("ts_us"), F.col("_temps").cast(f"array<{temps.schema['temp'].dataType.simpleString()}>").alias("temp"), F.lit(period_us).alias("period_us"), "is_full", F.size("_times").alias("num_entries"))


def distribution_sums(temps: DataFrame, at: DataFrame, period_us: int = PERIOD_US, keys=KEYS) -> DataFrame:
    """Per probe (probe_id, at_us): sum_temp and num_entries of the trailing readings, and is_full."""

    def read(windows: pa.Table, seen: Readings) -> Iterator[tuple[int, int, list[pa.Array]]]:
        until = column(windows, "at_us")
        low, high = seen.places(until - period_us, until)
        known = seen.temps != MISSING
        sums, counts = (np.concatenate(([0], np.cumsum(x, dtype=np.int64))) for x in (np.where(known, seen.temps, 0), known))
        yield 0, len(windows), [pa.array(sums[high] - sums[low], mask=counts[high] == counts[low]), pa.array((high - low).astype(np.int64))]

    rows = read_windows(at.select(*keys, "probe_id", "at_us"), temps, F.col("at_us") - period_us, "at_us", read, "sum_temp long, num_entries long", period_us, keys=keys)
    return _with_full(rows.where("num_entries > 0"), temps, period_us, keys).select(*keys, "probe_id", "sum_temp", "num_entries", "is_full")


def line_filters(column: Column, simple=(), regex=()) -> Column:
    """Whether any of the filters holds: substrings and patterns are alternatives."""
    tests = [column.contains(s) for s in simple] + [column.rlike(r) for r in regex]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(True)
