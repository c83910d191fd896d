"""Line dedup over windows of three consecutive lines.

Lines are the \\n-separated parts of a text, compared without the white space at their ends. Every window of three consecutive lines with a
word in it is hashed to 128 bits; a window that occurs more than once in the corpus keeps its first occurrence (smallest doc_id, then position)
and each later one goes: the positions that later occurrences cover are merged and the lines there are removed. Windows overlap, so a run
of one line shrinks to its first line, and a line that a first and a later occurrence share goes.

Null text stays null and texts of fewer than three lines have no windows. Rows with equal doc_id, or none, are told apart by their text; rows
that are equal in both count as one document and are treated alike. A document all of whose lines go keeps its row, with empty text. A text
of any length is compared whole. An empty table gives an empty result, and further columns of the input pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

WINDOW = 3
#: Stripped from the ends of a line.
BLANKS = " \t\r\x0b\x0c"
_REBUILT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])


def window_hashes(text: str) -> list[tuple[int, bytes]]:
    """(position, 128-bit hash) of each window that has a word."""
    lines = [x.strip(BLANKS) for x in text.split("\n")]
    windows = ((k, "\n".join(lines[k : k + WINDOW])) for k in range(len(lines) - WINDOW + 1))
    return [(k, xxhash.xxh3_128_digest(w.encode("utf-8", "surrogatepass"))) for k, w in windows if len(w) >= WINDOW]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, places, hashes = [], [], []
        for row, text in enumerate(batch.column("text")):
            for place, digest in window_hashes(text.as_py() or ""):
                rows.append(row)
                places.append(place)
                hashes.append(digest)
        halves = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
        at = pa.array(rows, pa.int64())
        columns = [batch.column("doc").take(at), batch.column("hash").take(at), pa.array(places, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "hash", "pos", "h1", "h2"])


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, hash, text, and the whole row."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"), row).withColumn("hash", F.xxhash64("text"))


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, hash (of the text) and pos of every occurrence of a window but its first."""
    keyed = _keyed(docs, doc_id, text).select("doc", "hash", "text")
    found = written(keyed.mapInArrow(_windows, f"doc {dict(keyed.dtypes)['doc']}, hash long, pos int, h1 long, h2 long"))  # read twice
    place = F.struct("doc", "hash", "pos")
    firsts = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return found.join(firsts, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select("doc", "hash", "pos")


@F.pandas_udf(_REBUILT)
def _rebuilt(text: pd.Series, starts: pd.Series) -> pd.DataFrame:
    """The text without the lines that windows at these positions cover."""
    out = []
    for t, at in zip(text, starts, strict=True):
        if t is None:
            out.append((None, 0, 0))
        elif at is None:
            out.append((t, t.count("\n") + 1, 0))
        else:
            lines = t.split("\n")
            gone = {k for p in at for k in range(p, p + WINDOW)}
            out.append(("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])


def _cut(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """row and new: the text that is left, with its numbers of lines before and of lines removed."""
    covered = repeated_windows(docs, doc_id, text).groupBy("doc", "hash").agg(F.collect_set("pos").alias("at")).alias("c")
    same = F.col("d.doc").eqNullSafe(F.col("c.doc")) & (F.col("d.hash") == F.col("c.hash"))
    joined = _keyed(docs, doc_id, text).alias("d").join(covered, same, "left")
    return joined.select("d.row", _rebuilt(F.col("d.text"), F.col("c.at")).alias("new"))


def _columns(docs: DataFrame, text: str) -> list[Column]:
    return [F.col("new.text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns]


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the lines of later occurrences removed from text."""
    return _cut(docs, doc_id, text).select(*_columns(docs, text))


def count_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """As dedup_lines, with two more columns: how many lines the text had, and how many were removed."""
    if {n_lines.lower(), n_removed.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError("docs has columns of these names; choose others")
    return _cut(docs, doc_id, text).select(*_columns(docs, text), F.col("new.n_lines").alias(n_lines), F.col("new.n_removed").alias(n_removed))
