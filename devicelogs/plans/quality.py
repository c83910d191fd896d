"""Stitching and checks of log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.timeops import KEYS, TOKENS_PER_SLICE, lag, running


def stitch(raw: DataFrame, line: str = "line", keys=KEYS, lines_per_part: int = TOKENS_PER_SLICE) -> DataFrame:
    """Distinct lines, dealt by stream and token range and sorted inside: the order of a stream is that of its ranges."""
    distinct = raw.withColumn("line_md5", F.md5(line)).dropDuplicates([*keys, "line_md5"])
    part = distinct.withColumn("part", F.floor(F.col("token") / lines_per_part))
    return part.repartition(*keys, "part").sortWithinPartitions(*keys, "part", "token", "trace_time", "line_md5")


def stitch_check(log: DataFrame, line: str = "line", expected_boot: Column | None = None, keys=KEYS, slices: Column | None = None, order=("token", "trace_time", "line_id")) -> DataFrame:
    """Per stream: line_count, and whether a line equals the one before, has another boot, or a token below the one before."""
    seen = running(log.withColumn("_md5", F.md5(line)), {"_b": lag(F.struct("_md5", "token"))}, keys, order, slices)
    wrong = F.lit(False) if expected_boot is None else F.coalesce(F.col("boot_id") != expected_boot, F.lit(True))
    return seen.groupBy(*keys).agg(
        F.count("*").alias("line_count"), F.coalesce(F.bool_or(F.col("_md5") == F.col("_b.v._md5")), F.lit(False)).alias("duplicate"),
        F.bool_or(wrong).alias("wrong_boot"), F.coalesce(F.bool_or(F.col("token") < F.col("_b.v.token")), F.lit(False)).alias("token_decreasing"))


def tag_count(log: DataFrame, trace_tag: str | None = None, keys=KEYS) -> DataFrame:
    """Lines by tag; kernel-trace lines count under their trace tag."""
    tag = F.coalesce(F.col(trace_tag), F.col("tag")) if trace_tag else F.col("tag")
    return log.groupBy(*keys, tag.alias("tag")).agg(F.count("*").alias("n"))


def missing_loglines(log: DataFrame, keys=KEYS, slices: Column | None = None) -> DataFrame:
    """The maximal runs of tokens that are missing between the first and the last token of each stream."""
    tokens = log.select(*keys, "token").distinct()
    seen = running(tokens, {"_b": lag(F.col("token"))}, keys, ("token",), slices)
    runs = seen.where(F.col("token") > F.col("_b.v") + 1)
    return runs.select(*keys, (F.col("_b.v") + 1).alias("start"), (F.col("token") - 1).alias("end"))


def thermal_gaps(temps: DataFrame, large_s: float = 10.0, keys=KEYS, slices: Column | None = None, order=("trace_time", "line_id")) -> DataFrame:
    """temps with diff, the seconds since the reading before, and is_large; first readings are left out."""
    seen = running(temps, {"_b": lag(F.col("trace_time"))}, keys, order, slices)
    diff = F.col("trace_time") - F.col("_b.v")
    return seen.withColumns({"diff": diff, "is_large": diff > large_s}).where("diff is not null").drop("_b")
