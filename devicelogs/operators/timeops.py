"""Ordered operations within streams: running values, gaps, as-of joins and interval joins.

A stream is one (device, boot), and a boot is as a rule short enough to be ordered in one task; all windows over one stream then share a
single shuffle. For boots that are too long, ``running`` can cut a stream into slices of its order: windows run inside a slice, and what
comes before or after it is carried over from a small table with one row per slice. The input is written to spark.checkpoint.dir for that,
as it is read twice.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ("device_id", "boot_id")
ORDER = ("token", "trace_time", "line_id")
#: Tokens per slice, and microseconds per slice for streams in time order.
TOKENS_PER_SLICE = 1_000_000
DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Spec:
    """A running value: the first, last or next non-null value, or the total."""

    kind: str
    value: Column
    inclusive: bool = True


def last(value: Column, inclusive: bool = True) -> Spec:
    """Latest non-null value so far."""
    return Spec("last", value, inclusive)


def first(value: Column, inclusive: bool = True) -> Spec:
    """Earliest non-null value so far."""
    return Spec("first", value, inclusive)


def lag(value: Column) -> Spec:
    """Value of the row before, which may be null; a struct with the field v."""
    return Spec("last", F.struct(value.alias("v")), False)


def following(value: Column, inclusive: bool = False) -> Spec:
    """Earliest non-null value from here on."""
    return Spec("next", value, inclusive)


def total(value: Column, inclusive: bool = True) -> Spec:
    return Spec("total", value, inclusive)


def token_slice(size: int = TOKENS_PER_SLICE) -> Column:
    return F.floor(F.col("token") / size)


def time_slice(size: int = DAY_US, column: str = "ts_us") -> Column:
    return F.floor(F.col(column) / size)


def new_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a local test session gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/logs-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, specs: dict[str, Spec], keys=KEYS, order=ORDER, slices: Column | None = None) -> DataFrame:
    """df with a column for each spec. ``slices``, a number that doesn't fall along the order, bounds what one task orders."""
    order = [c for c in order if c in df.columns]
    keys = list(keys)
    if slices is None:
        return df.select("*", *[_within(s, keys, order).alias(name) for name, s in specs.items()])
    cut, place = written(df.withColumn("_slice", slices)), F.struct(*order)
    by_slice, up_to = Window.partitionBy(*keys), (Window.unboundedPreceding, -1)
    before, after = by_slice.orderBy("_slice").rowsBetween(*up_to), by_slice.orderBy(F.desc("_slice")).rowsBetween(*up_to)
    within, edge, carried, merged = {}, [], {}, {}
    for name, s in specs.items():
        here, there = f"_in_{name}", f"_of_{name}"
        within[here] = _within(s, [*keys, "_slice"], order)
        known = F.when(s.value.isNotNull(), place)
        if s.kind == "last":
            edge.append(F.max_by(s.value, known).alias(there))
            carried[there] = F.last(there, True).over(before)
        elif s.kind == "first":
            edge.append(F.min_by(s.value, known).alias(there))
            carried[there] = F.first(there, True).over(before)
        elif s.kind == "next":
            edge.append(F.min_by(s.value, known).alias(there))
            carried[there] = F.last(there, True).over(after)
        else:
            edge.append(F.sum(s.value).alias(there))
            carried[there] = F.coalesce(F.sum(there).over(before), F.lit(0))
        near, far = (there, here) if s.kind == "first" else (here, there)
        merged[name] = F.col(here) + F.col(there) if s.kind == "total" else F.coalesce(F.col(near), F.col(far))
    ends = cut.groupBy(*keys, "_slice").agg(*edge).withColumns(carried)
    joined = cut.withColumns(within).join(ends, [*keys, "_slice"])
    return joined.select(*df.columns, *[c.alias(n) for n, c in merged.items()])


def _within(s: Spec, keys: list[str], order: list[str]) -> Column:
    """Every frame reaches back from the row, in reverse order for what follows: Spark adds one row at a time to it."""
    turned = [F.col(c).desc() for c in order] if s.kind == "next" else order
    back = Window.partitionBy(*keys).orderBy(*turned).rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1)
    if s.kind in ("last", "next"):
        return F.last(s.value, True).over(back)
    if s.kind == "first":
        return F.first(s.value, True).over(back)
    return F.coalesce(F.sum(s.value).over(back), F.lit(0))


def flag_gaps(log: DataFrame, keys=KEYS, slices: Column | None = None) -> DataFrame:
    """log with gap: whether lines are missing before this one. Tokens that go back are no gap."""
    seen = running(log, {"_before": lag(F.col("token"))}, keys, slices=slices)
    gap = F.coalesce((F.col("_before.v") != 0) & (F.col("token") > F.col("_before.v") + 1), F.lit(False))
    return seen.withColumn("gap", gap).drop("_before")


def gap_epochs(log: DataFrame, keys=KEYS, slices: Column | None = None) -> DataFrame:
    """log with gap and gap_epoch, the number of gaps so far: states and sessions don't reach over one."""
    flagged = flag_gaps(log, keys, slices)
    return running(flagged, {"gap_epoch": total(F.col("gap").cast("long"))}, keys, slices=slices)


def asof_last(left: DataFrame, right: DataFrame, value: Column, name: str, keys=KEYS, time: str = "ts_us", inclusive: bool = True, slices: Column | None = None) -> DataFrame:
    """left with the latest value of right at or before each row's time."""
    both = left.withColumns({"_v": F.lit(None).cast(right.select(value).schema[0].dataType), "_side": F.lit(1 if inclusive else 0)})
    other = right.select(*keys, time, value.alias("_v"), F.lit(0 if inclusive else 1).alias("_side"))
    union = both.unionByName(other.withColumn("_right", F.lit(True)), allowMissingColumns=True)
    found = running(union, {name: last(F.col("_v"))}, keys, (time, "_side"), slices)
    return found.where("_right is null").drop("_v", "_side", "_right")


def asof_nearest(left: DataFrame, right: DataFrame, tolerance_us: int | Column, probe: str = "ts_us", time: str = "ts_us", value: str = "temp", keys=KEYS, until: Column | None = None, slices: Column | None = None) -> DataFrame:
    """left with near_ts, near_value (null beyond the tolerance, which itself passes) and near_delta; of equally near readings the earlier.

    ``until`` excludes readings after that time.
    """
    point = F.struct(F.col(time).alias("t"), F.col(value).alias("v"))
    probes = left.withColumns({"_t": F.col(probe), "_side": F.lit(1)})
    readings = right.select(*keys, F.col(time).alias("_t"), point.alias("_p"), F.lit(0).alias("_side"), F.lit(True).alias("_right"))
    union = probes.unionByName(readings, allowMissingColumns=True)
    found = running(union, {"_back": last(F.col("_p")), "_ahead": following(F.col("_p"))}, keys, ("_t", "_side"), slices).where("_right is null")
    ahead = F.col("_ahead") if until is None else F.when(F.col("_ahead.t") <= until, F.col("_ahead"))
    back_delta, ahead_delta = F.col("_t") - F.col("_back.t"), ahead["t"] - F.col("_t")
    near = F.when(ahead_delta.isNull() | (back_delta <= ahead_delta), F.col("_back")).otherwise(ahead)
    delta = F.abs(near["t"] - F.col("_t"))
    passes = delta <= tolerance_us
    out = found.select(*left.columns, near["t"].alias("near_ts"), F.when(passes, near["v"]).alias("near_value"), delta.alias("near_delta"))
    return out


def interval_join(left: DataFrame, right: DataFrame, start: str, end: str, bucket_us: int, time: str = "ts_us", keys=KEYS, closed: bool = False) -> DataFrame:
    """Rows of left (intervals) with the rows of right whose time lies in [start, end), or [start, end] if closed.

    Both sides meet in equi-joined time buckets, into which an interval is expanded; choose the bucket about as long as the intervals.
    """
    until = F.col(end) if closed else F.col(end) - 1
    spans = left.where(F.col(start) <= until).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket_us), F.floor(until / bucket_us))))
    points = right.withColumn("_bucket", F.floor(F.col(time) / bucket_us)).withColumnRenamed(time, f"_{time}")
    inside = (F.col(f"_{time}") >= F.col(start)) & (F.col(f"_{time}") <= until)
    joined = spans.join(points, [*keys, "_bucket"]).where(inside).drop("_bucket")
    return joined.drop(time).withColumnRenamed(f"_{time}", time) if time not in left.columns else joined.withColumnRenamed(f"_{time}", f"right_{time}")


def asof_next(left: DataFrame, right: DataFrame, value: Column, name: str, probe: str = "ts_us", time: str = "ts_us", keys=KEYS, slices: Column | None = None) -> DataFrame:
    """left with the earliest value of right strictly after each row's probe time."""
    probes = left.withColumns({"_t": F.col(probe), "_side": F.lit(1)})
    points = right.select(*keys, F.col(time).alias("_t"), value.alias("_v"), F.lit(0).alias("_side"), F.lit(True).alias("_right"))
    union = probes.unionByName(points, allowMissingColumns=True)
    found = running(union, {name: following(F.col("_v"))}, keys, ("_t", "_side"), slices).where("_right is null")
    return found.select(*left.columns, name)
