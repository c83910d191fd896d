"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space, tab, newline, vertical tab, form feed, carriage return.
#: bytes.split() splits at exactly these.
SPACES = b" \t\n\x0b\x0c\r"
#: Most rows that small_batches lets pass between Spark and Python at once.
BATCH_ROWS = 1_000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")  # a local session: one machine
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: it survives lost executors and ends the lineage."""
    return _stored(df, shared_dir(df.sparkSession))


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Lets rows pass between Spark and Python in Arrow batches of BATCH_ROWS at most, for plans that this session makes from now on.

    Executor, pipe and worker each hold a batch, and with Spark's own bound of 10,000 rows a whole split of documents is one.
    """
    rows = int(spark.conf.get(_BATCH_ROWS))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(_BATCH_ROWS, str(BATCH_ROWS))


def _give_back() -> None:
    """Freed memory of this worker goes back to the system: the worker stays, idle or for other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frees_batches(run: Callable) -> Callable:
    """run, a function of mapInArrow, that gives its memory back at the end."""

    @functools.wraps(run)
    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return outer


def frees_group(run: Callable) -> Callable:
    """run, a function of applyInPandas or applyInArrow, that gives its memory back at the end."""

    @functools.wraps(run)
    def outer(rows):
        made = run(rows)
        _give_back()
        return made

    return outer


class Scratch:
    """Tables in the shared folder that go when what comes after them is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, shared_dir(spark), {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        made = _stored(df, path)
        self.paths[id(made)] = (made, path)
        return made

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables of this folder that nothing will read again."""
        jvm = self.spark._jvm
        for table in tables:
            made, path = self.paths[id(table)]
            if made is table:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """These names, each with as many underscores before it as make it differ from the taken ones, whatever their case."""
    lower = {t.lower() for t in taken}
    found = []
    for name in names:
        while name.lower() in lower:
            name = f"_{name}"
        lower.add(name.lower())
        found.append(name)
    return found


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True for the rows whose labels must not be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
