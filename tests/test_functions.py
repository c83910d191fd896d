"""Algorithms in Python, the table function and line counts on odd rows."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from devicelogs.functions import algorithms, parse

ALARM = "alarm_key string, readings array<struct<ts_us: long, temp: int>>, when_rtc_us long, window_length_ms long, window_us long, percentiles array<int>, trigger_temp int"
LINE = "d\t1480600000000\t1480600000000.5\tb\t7\t1.5\t2016-12-01 08:26:40.000000  96  136 D tag: text"


@pytest.fixture
def alarms(spark):
    rows = [
        ("falls", [(10, 30), (20, 34), (30, 31), (40, 28), (50, 29)], 15, 1, 1000, [28], 30),
        ("rises", [(10, 30), (20, 31)], 0, 1, 1000, [28], 30),
        ("before", [(10, 30), (20, 29)], 100, 1, 1000, [28], 30),
        ("none", [], 0, 1, 1000, [28], 30),
        ("null", None, 0, 0, 0, None, None),
    ]
    return spark.createDataFrame(rows, ALARM)


def test_vectorized_algorithm(alarms):
    full = alarms.where("readings is not null")
    got = {r.alarm_key: r.t for r in full.select("alarm_key", algorithms.steepest_fall()().alias("t")).collect()}
    assert got == {"falls": 31, "rises": 31, "before": 29, "none": None}
    count = algorithms.vectorized(lambda times, temps, when, window, percentiles, trigger: int(np.sum(times >= when)) + trigger + len(percentiles))
    got = {r.alarm_key: r.t for r in full.select("alarm_key", count().alias("t")).collect()}
    assert got == {"falls": 35, "rises": 33, "before": 31, "none": 31}
    plan = full.select(algorithms.steepest_fall()().alias("t"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "BatchEvalPython" not in plan


def test_readings_by_percent(alarms):
    got = sorted(map(tuple, algorithms.readings_by_percent(alarms).collect()))
    assert got == [("falls", 0, 1, 34), ("falls", 1, 1, 31), ("falls", 2, 1, 28), ("falls", 3, 1, 29), ("rises", 1, 1, 30), ("rises", 2, 1, 31)]


def test_lines_are_counted_once(spark):
    lines = [LINE, LINE[:20], LINE[:40], "", None, "-- restart", "d\t1480600000000", "d x y", LINE + " more"]
    raw = spark.createDataFrame([(x, str(k % 2)) for k, x in enumerate(lines)], "value string, file string")
    metrics = Observation()
    assert parse.parse_loglines(parse.counted_lines(raw, metrics)).count() == 2
    assert metrics.get == {"lines": 9, "parsed": 2, "cut": 3, "rejected": 4}
    by_file = parse.lines_by_file(raw).groupBy().agg(*[F.sum(c).alias(c) for c in ("lines", "parsed", "rejected", "cut")]).first().asDict()
    assert by_file == metrics.get
    empty = Observation()
    assert parse.counted_lines(raw.limit(0), empty).count() == 0 and parse.lines_by_file(raw.limit(0)).count() == 0
    assert set(empty.get.values()) <= {0}
