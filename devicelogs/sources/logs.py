"""Reading raw and stitched logs, selections, and writing results.

A stitched log is Parquet by device and boot, whose part files hold ranges of tokens in order. Beside them, in folders that readers of the
log pass over, lie its manifest: one row for each part file with its range of tokens and times, Bloom filters of the lines in each part, and
the raw files that have been taken. Device and boot ids are text and are read as they were written, whatever they look like.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.distribution import line_filters
from ..operators.timeops import KEYS, TOKENS_PER_SLICE, interval_join, written
from ..plans.quality import stitch

LINES_PER_FILE = 100_000
#: Bits and hashes of a part's Bloom filter: about one in a hundred lines of a full part is looked up in vain. Stored filters keep theirs.
BLOOM_BITS = 1 << 20
BLOOM_HASHES = 4
_BITMAP = 32_768  # bits of one stored piece
_LINE = [*KEYS, "line_md5"]


def read_raw(spark: SparkSession, paths: str | list[str], pattern: str = "*.out.gz", devices: list[str] | None = None) -> DataFrame:
    """Lines (value) of raw device files with their file; gz files are one task each."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(paths)
    found = lines.select("value", F.col("_metadata.file_path").alias("file"))
    return found if devices is None else found.where(F.split("value", r"\s+", 2)[0].isin(devices))


def read_device_files(spark: SparkSession, root: str, devices: list[str], layout: str = "{device}/time", pattern: str = "*.out.gz", stream: bool = False) -> DataFrame:
    """Lines (value) of the chosen devices' raw files with their file, as a table or as a stream. Other devices' files are not even listed.

    ``layout`` is a device's folder below the root; it may go on with a pattern of days, as in "{device}/time/2017/0[1-3]".
    """
    chosen = "{" + ",".join(devices) + "}" if len(devices) > 1 else devices[0]
    reader = (spark.readStream if stream else spark.read).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.text(f"{root.rstrip('/')}/{layout.format(device=chosen)}").select("value", F.col("_metadata.file_path").alias("file"))


def _with_text_ids(schema: StructType) -> StructType:
    return StructType([StructField(f.name, StringType() if f.name in KEYS else f.dataType) for f in schema])


def read_loglines(spark: SparkSession, root: str, devices: list[str] | None = None, boot_ids: list[str] | None = None) -> DataFrame:
    """A stitched table; devices and boots prune partitions."""
    log = spark.read.schema(_with_text_ids(spark.read.parquet(root).schema)).parquet(root)
    if devices is not None:
        log = log.where(F.col("device_id").isin(devices))
    return log if not boot_ids else log.where(F.col("boot_id").isin(boot_ids))


def in_daterange(df: DataFrame, days: str, ts: str = "ts") -> DataFrame:
    """Rows of the inclusive days "yyyymmdd-yyyymmdd"."""
    first, until = (F.to_timestamp(F.lit(x), "yyyyMMdd") for x in days.split("-"))
    return df.where((F.col(ts) >= first) & (F.col(ts) < until + F.expr("interval 1 day")))


def line_filter(df: DataFrame, simple=(), regex=(), column: str | Column = "line") -> DataFrame:
    """Rows that pass any of the filters."""
    return df.where(line_filters(F.col(column) if isinstance(column, str) else column, simple, regex))


def write_stitched(log: DataFrame, path: str, mode: str = "overwrite", lines_per_file: int = LINES_PER_FILE) -> None:
    """A stitched log as Parquet by device and boot, in ranges of tokens: parts don't overlap, and ranges of dates pass over parts."""
    order = [*KEYS, *[c for c in ("token", "trace_time", "line_md5") if c in log.columns]]
    rows = log.drop("part").repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.mode(mode).option("maxRecordsPerFile", lines_per_file).partitionBy(*KEYS).parquet(path)


def build_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Per part file of a stitched log: first and last token, first and last time in ns, and lines."""
    return _summary(read_loglines(spark, path).withColumn("file", F.col("_metadata.file_path")), "file")


def _summary(log: DataFrame, part: str) -> DataFrame:
    tokens = [F.min("token").alias("first_token"), F.max("token").alias("last_token")] if "token" in log.columns else []
    return log.groupBy(*KEYS, part).agg((F.min("ts_us") * 1000).alias("start_ns"), (F.max("ts_us") * 1000).alias("end_ns"), F.count("*").alias("lines"), *tokens)


def new_files(raw: DataFrame, consumed: DataFrame) -> DataFrame:
    """The lines of files that an earlier run has not taken."""
    return raw.join(consumed.select("file").distinct(), "file", "left_anti")


# The manifest that is stored


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _stored(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    return spark.read.parquet(f"{path}/_{name}") if _there(spark, f"{path}/_{name}") else None


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored manifest: part, device_id, boot_id, tokens, times and lines; None before the first step."""
    return _stored(spark, path, "manifest")


def consumed(spark: SparkSession, path: str) -> DataFrame | None:
    """The raw files (file) that have been stitched into the log; None before the first step."""
    return _stored(spark, path, "consumed")


def _part_name(file: str) -> str:
    return file[file.index("/device_id=") + 1 :]


def _parts(spark: SparkSession, path: str) -> dict[str, str]:
    """Part files of a log by their names below it. File names are all that comes to the driver, as for any read."""
    if not _there(spark, path):
        return {}
    try:
        files = spark.read.parquet(path).inputFiles()
    except Exception as e:  # an empty log has no schema
        if "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return {}
    return {_part_name(f): unquote(f) for f in files}


def _read_parts(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    reader = spark.read.option("basePath", path)
    rows = reader.schema(_with_text_ids(reader.parquet(*files).schema)).parquet(*files)
    return rows.withColumn("part", F.regexp_extract(F.col("_metadata.file_path"), "/(device_id=.*)$", 1))


def _bits(line_md5: str) -> Column:
    """The places of a line in a Bloom filter."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(k), line_md5), F.lit(BLOOM_BITS)) for k in range(BLOOM_HASHES)])


def refresh_manifest(spark: SparkSession, path: str) -> None:
    """Adds the parts that the manifest doesn't list, which are those of the last write, or of a run that ended before it could."""
    there, known = _parts(spark, path), manifest(spark, path)
    listed = {r.part for r in known.select("part").collect()} if known is not None else set()
    fresh = [file for name, file in sorted(there.items()) if name not in listed]
    if not fresh:
        return
    rows = _read_parts(spark, path, fresh)
    bits = rows.select("part", F.explode(_bits("line_md5")).alias("bit")).groupBy("part", F.floor(F.col("bit") / _BITMAP).alias("piece"))
    bits.agg(F.bitmap_construct_agg(F.col("bit") % _BITMAP).alias("bits")).write.mode("append").parquet(f"{path}/_blooms")
    _summary(rows, "part").write.mode("append").parquet(f"{path}/_manifest")  # after the filters: what is listed has them


def overlapping_parts(spark: SparkSession, path: str, lines: DataFrame) -> list[str]:
    """The part files that may hold one of the lines: their tokens reach over it, and their Bloom filter doesn't exclude it."""
    known = manifest(spark, path)
    if known is None:
        return []
    spans = known.select(*KEYS, "part", "first_token", "last_token")
    pairs = interval_join(spans, lines.select(*_LINE, "token"), "first_token", "last_token", TOKENS_PER_SLICE, "token", closed=True)
    probes = pairs.select("part", *_LINE, F.posexplode(_bits("line_md5")).alias("k", "bit"))
    probes = probes.withColumn("piece", F.floor(F.col("bit") / _BITMAP))
    place = F.col("bit") % _BITMAP
    byte = F.conv(F.hex(F.expr(f"substring(bits, int(bit % {_BITMAP} div 8) + 1, 1)")), 16, 10).cast("int")
    is_set = F.expr("shiftright(_byte, _at) & 1") == 1
    hits = probes.join(_stored(spark, path, "blooms"), ["part", "piece"]).withColumns({"_byte": byte, "_at": (place % 8).cast("int")}).where(is_set)
    found = hits.groupBy("part", *_LINE).agg(F.count_distinct("k").alias("n")).where(F.col("n") == BLOOM_HASHES)
    names, there = [r.part for r in found.select("part").distinct().collect()], _parts(spark, path)
    return sorted(there[n] for n in names)


def stitch_step(raw: DataFrame, path: str, parse) -> DataFrame:
    """Stitches the raw files (value, file) that are new onto the log at path, whose lines stay single; returns the files taken.

    Of the log only the parts are read that may hold one of the new lines. Lines are written first, then the manifest, then the files taken,
    so a run that ends in between is made good by the next one: the lines that it wrote are found again and not added.
    """
    spark = raw.sparkSession
    taken = consumed(spark, path)
    fresh = raw if taken is None else new_files(raw, taken)
    files = written(fresh.select("file").distinct())
    refresh_manifest(spark, path)
    lines = written(stitch(parse(fresh)).drop("part"))
    parts = overlapping_parts(spark, path, lines)
    if parts:
        lines = lines.join(_read_parts(spark, path, parts).select(*_LINE), _LINE, "left_anti")
    if not lines.isEmpty():
        write_stitched(lines, path, "append")
    refresh_manifest(spark, path)
    files.write.mode("append").parquet(f"{path}/_consumed")
    return files


def stitch_incrementally(raw: DataFrame, consumed: DataFrame | None, path: str, parse) -> DataFrame:
    """As stitch_step, for callers that keep the files taken themselves; without them the log is written anew."""
    if consumed is None:
        write_stitched(stitch(parse(raw)), path)
        return raw.select("file").distinct()
    return stitch_step(new_files(raw, consumed), path, parse)


def write_result(df: DataFrame, root: str, job: str, form: str = "json") -> None:
    """A job's result below <root>/analysis/<job>, by device. Devices that df has no rows of keep their results."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("device_id")
    (writer.option("compression", "gzip") if form == "json" else writer).format(form).save(f"{root}/analysis/{job}")


def result_sink(root: str, job: str, form: str = "json"):
    """For foreachBatch: a micro-batch's rows below <root>/analysis/<job>/batch=<id>. A batch that is given again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("device_id").format(form).save(f"{root}/analysis/{job}/batch={batch_id}")

    return write
