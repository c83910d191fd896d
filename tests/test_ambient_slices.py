"""Ambient temperatures of boots cut into slices equal the walk over whole boots."""

import random

import pytest
from pyspark.sql import functions as F

from devicelogs.operators import timeops
from devicelogs.plans import ambient

SCHEMA = "device_id string, boot_id string, token long, line_id long, ts_us long, pm string, temp int, charge string"


def events(seed, n, boots=("a", "b")):
    rng, rows = random.Random(seed), []
    for boot in boots:
        ts = 0
        for k in range(1, n + 1):
            ts += rng.choice([1, 5, 30, 90])
            kind = rng.choice(["entry", "exit", "temp", "temp", "charge"])
            temp = rng.choice([0, -2, 20, 30, 33, 36, 40, rng.randint(-5, 50)])
            rows.append(("d", boot, k, k, ts, kind if kind in ("entry", "exit") else None, temp if kind == "temp" else None, rng.choice(["unplugged", "unplugged", "charging"]) if kind == "charge" else None))
    return rows


def slow(rows, least_sleep, max_temp=35, least_awake=None):
    """The state machine over all lines of one boot, as it is described."""
    entry = left = None
    before, temp, waiting, out = 0, 0, False, []
    for r in rows:
        ts, pm, reading = r[4], r[5], r[6]
        if pm == "entry":
            short = left is not None and (least_awake is None or ts - left < least_awake)
            if not (short and before != 0 and temp <= before):
                waiting = waiting and left is None
                entry, before = ts, temp
        elif pm == "exit":
            left = ts
            waiting = waiting or (entry is not None and ts - entry > least_sleep)
        elif reading is not None:
            temp = reading
            if waiting and temp <= max_temp:
                out.append((ts, temp))
                waiting, entry, left = False, None, None
    return out


@pytest.mark.parametrize("seed, awake", [(1, None), (2, None), (3, 60), (4, 20)])
def test_slices_equal_the_walk(spark, seed, awake):
    rows = events(seed, 900)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted((b, *x) for b in ("a", "b") for x in slow([r for r in rows if r[1] == b], 40, 35, awake))
    assert len(want) > 5
    for slices in (None, timeops.token_slice(17)):
        found = ambient.ambient_from_suspend(df, 40, 35, awake, slices=slices)
        assert sorted((r.boot_id, r.ts_us, r.ambient_temp) for r in found.collect()) == want


def test_unplugged_only(spark):
    df = spark.createDataFrame(events(9, 500), SCHEMA)
    whole = ambient.ambient_from_suspend(df, 40, require_unplugged=True)
    cut = ambient.ambient_from_suspend(df, 40, require_unplugged=True, slices=timeops.token_slice(25))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect())) and whole.count()


@pytest.mark.parametrize("seed", range(30))
def test_tables_compose_from_any_state(seed):
    """A slice's table gives what a walk from that state gives, for all kinds of states."""
    rng, ts, records, gone = random.Random(seed), 1000, [], 990
    for _ in range(rng.randint(1, 40)):
        ts += rng.randint(1, 60)
        pm = rng.choice(["entry", "exit"])
        records.append({"pm": pm, "ts_us": ts, "temp_before": rng.choice([0, -3, 20, 30, 31, 45]), "gone_us": gone, "cool_ts": rng.choice([None, None, ts]), "cool_temp": 30})
        gone = ts if pm == "exit" else gone
    awake = rng.choice([None, 30])
    cells = ambient.transfer(records, 50, awake)
    states = [(e, left, b, w) for e in (None, 1, 940, 960, 990) for left in (False, True) for b in (-9, -3, 0, 19, 20, 30, 99) for w in (False, True) if not w or (e is not None and left)]
    for state in states:
        entry, left, before, waiting = state
        for r in records:
            if r["pm"] == "entry":
                if not (left and (awake is None or r["ts_us"] - r["gone_us"] < awake) and before != 0 and r["temp_before"] <= before):
                    entry, before, waiting = r["ts_us"], r["temp_before"], waiting and not left
            else:
                left = True
                waiting = waiting or (entry is not None and r["ts_us"] - entry > 50)
            if waiting and r["cool_ts"] is not None:
                entry, left, waiting = None, False, False
        assert ambient.enter(cells, state) == (entry, left, before, waiting)


def test_one_long_boot_in_many_tasks(spark):
    n = 60_000
    k = F.col("id")
    rows = spark.range(n).select(F.lit("d").alias("device_id"), F.lit("b").alias("boot_id"), k.alias("token"), k.alias("line_id"), (k * 7).alias("ts_us"),
        F.when(F.xxhash64("id") % 3 == 0, F.when(F.xxhash64("id", F.lit(1)) % 2 == 0, "entry").otherwise("exit")).alias("pm"), (F.floor(k / 3000) + F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3)) + 10).cast("int").alias("temp"))
    rows = rows.withColumn("temp", F.when(F.col("pm").isNull(), F.col("temp")))
    whole = ambient.ambient_from_suspend(rows, 60)
    cut = ambient.ambient_from_suspend(rows, 60, slices=timeops.token_slice(3000))
    assert cut.exceptAll(whole).isEmpty() and whole.exceptAll(cut).isEmpty() and whole.count() > 5
