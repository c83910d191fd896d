"""Ids as text, the stored manifest, device folders and result sinks."""

from pyspark.sql import functions as F

from devicelogs.sources import logs

SCHEMA = "device_id string, boot_id string, token long, trace_time double, ts_us long, line string, file string"
parse = lambda df: df.drop("file")


def lines(spark, file, tokens, device="0123", boot="01"):
    return spark.createDataFrame([(device, boot, t, float(t), t * 1000, f"{device} {boot} {t}", file) for t in tokens], SCHEMA)


def tokens(spark, path, **where):
    return sorted(r.token for r in logs.read_loglines(spark, path, **where).collect())


def test_ids_stay_text(spark, tmp_path):
    path = str(tmp_path / "log")
    both = lines(spark, "a", [1, 2, 3]).unionByName(lines(spark, "a", [1, 2], "123", "1")).unionByName(lines(spark, "a", [7], "a b%c", "x=y"))
    logs.stitch_step(both, path, parse)
    assert {(r.device_id, r.boot_id) for r in logs.read_loglines(spark, path).collect()} == {("0123", "01"), ("123", "1"), ("a b%c", "x=y")}
    assert tokens(spark, path, devices=["0123"]) == [1, 2, 3] and tokens(spark, path, boot_ids=["1"]) == [1, 2]
    logs.stitch_step(both.withColumn("file", F.lit("b")), path, parse)
    assert tokens(spark, path) == [1, 1, 2, 2, 3, 7]
    assert {(r.device_id, r.boot_id, r.lines) for r in logs.build_manifest(spark, path).collect()} == {("0123", "01", 3), ("123", "1", 2), ("a b%c", "x=y", 1)}
    assert logs.manifest(spark, path).count() == len(logs._parts(spark, path)) == 3


def test_only_overlapping_parts_are_read(spark, tmp_path):
    path = str(tmp_path / "log")
    for k in range(4):
        logs.stitch_step(lines(spark, f"f{k}", range(100 * k, 100 * k + 90)), path, parse)
    assert len(logs._parts(spark, path)) >= 4
    stitched = lambda t: logs.stitch(parse(lines(spark, "x", t)))
    inside = lambda t: logs.overlapping_parts(spark, path, stitched(t))
    assert inside([195, 1000]) == []  # between parts and behind them
    hit = inside([120, 121])
    assert hit and all(r.first_token <= 121 and r.last_token >= 120 for r in logs.build_manifest(spark, path).collect() if any(r.file.endswith(h.split("/")[-1]) for h in hit))
    other = stitched([120]).withColumn("line_md5", F.md5(F.lit("another line of that token")))
    assert logs.overlapping_parts(spark, path, other) == []  # the Bloom filter excludes it
    logs.stitch_step(lines(spark, "f9", range(80, 130)), path, parse)
    assert tokens(spark, path) == sorted({*range(130), *range(200, 290), *range(300, 390), *range(100, 190)})


def test_rerun_after_a_crash(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    logs.stitch_step(lines(spark, "a", [1, 2, 3]), path, parse)
    two = lines(spark, "a", [1, 2, 3]).unionByName(lines(spark, "b", [3, 4, 5]))
    calls, real = [], logs.refresh_manifest

    def dies(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        real(*args)

    monkeypatch.setattr(logs, "refresh_manifest", dies)
    try:
        logs.stitch_step(two, path, parse)
    except RuntimeError:
        pass
    monkeypatch.undo()
    assert tokens(spark, path) == [1, 2, 3, 4, 5] and logs.consumed(spark, path).count() == 1
    assert [r.file for r in logs.stitch_step(two, path, parse).collect()] == ["b"]
    assert tokens(spark, path) == [1, 2, 3, 4, 5] and logs.consumed(spark, path).count() == 2
    assert logs.stitch_step(two, path, parse).count() == 0 and tokens(spark, path) == [1, 2, 3, 4, 5]
    assert logs.manifest(spark, path).agg(F.sum("lines")).first()[0] == 5


def test_order_holds_over_parts(spark, tmp_path):
    path = str(tmp_path / "log")
    logs.write_stitched(logs.stitch(parse(lines(spark, "a", range(1000)))), path, lines_per_file=100)
    spans = sorted((r.first_token, r.last_token) for r in logs.build_manifest(spark, path).collect())
    assert len(spans) >= 10 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_device_folders(spark, tmp_path):
    root = tmp_path / "raw"
    for device in ("01", "1", "x"):
        (root / device / "time").mkdir(parents=True)
        (root / device / "time" / "a.out").write_text(f"{device} one\n{device} two\n")
    got = logs.read_device_files(spark, str(root), ["01", "x"], pattern="*.out")
    assert sorted(r.value for r in got.collect()) == ["01 one", "01 two", "x one", "x two"]
    assert all("/1/time" not in f for f in got.inputFiles()) and len(got.inputFiles()) == 2


def test_results_of_other_devices_stay(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "device_id string, n int")
    logs.write_result(df, str(tmp_path), "job")
    logs.write_result(df.where("device_id = 'a'").withColumn("n", F.lit(9)), str(tmp_path), "job")
    assert sorted((r.device_id, r.n) for r in spark.read.json(f"{tmp_path}/analysis/job").collect()) == [("a", 9), ("b", 2)]
    sink = logs.result_sink(str(tmp_path), "stream")
    for batch in (0, 1, 1):
        sink(df, batch)
    assert spark.read.json(f"{tmp_path}/analysis/stream").count() == 4
