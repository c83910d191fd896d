"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents become pieces of at most ``capacity`` tokens. The plan is made from the counts of the lengths alone: best-fit decreasing over
counts, where alike sequences are one group with a multiplicity. It is a table of slots: for a length, the ranks it serves, the first
sequence and the place in it. Pieces take their slots by a join on length and rank within length. Ranks come from running counts per task
and length that are offset by the counts of the tasks before, so no length is gathered in one task.

The plan has a bounded size: a length opens one group of sequences at most and splits one group at most, so there are no more than
2 * capacity groups, whatever the number of documents.

Null text counts as empty and gives one piece that holds the end token. Rows that are repeated, or have a null doc_id, are packed each for
itself; doc_id keeps its type and other columns are not read, whatever their names. A text of any length is cut into pieces. An empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import LONG_CHARS, default_tokenizer, encode_long, encoder, in_groups
from .common import frees_batches, written

CAPACITY = 4096
END_ID = 1

_PIECE = "doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, local long"
_PLAN = "length long, low long, high long, first long, each long, place long"


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, low, high, first, each, place): rank r of low <= r < high goes to sequence first + (r - low) // each, at place + (r - low) % each * length."""
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: runs of sequences (first, count)
    rooms: list[int] = []  # with groups, ascending
    slots, opened = [], 0

    def put(room: int, first: int, count: int) -> None:
        if count and room:
            if not groups[room]:
                insort(rooms, room)
            groups[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def fill(room: int, first: int, count: int) -> int:
            """Puts pieces of this length into count sequences with this room; returns how many pieces that took."""
            each = room // length
            full, rest = divmod(min(left, each * count), each)
            place = capacity - room
            if full:
                slots.append((length, rank, rank + full * each, first, each, place))
                put(room - each * length, first, full)
            if rest:
                slots.append((length, rank + full * each, rank + full * each + rest, first + full, rest, place))
                put(room - rest * length, first + full, 1)
            used = full + bool(rest)
            put(room, first + used, count - used)
            return full * each + rest

        while left:
            at = next((r for r in rooms if r >= length), None)
            if at is None:
                need = -(-left // (capacity // length))
                taken = fill(capacity, opened, need)
                opened += need
            else:
                first, count = groups[at].pop()
                if not groups[at]:
                    rooms.remove(at)
                taken = fill(at, first, count)
            left, rank = left - taken, rank + taken
    return slots


_END = np.array([END_ID], "<u4").tobytes()


def cut_pieces(raw: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids, four bytes each, and the end token."""
    n = len(raw) // 4 + 1
    if n <= capacity:
        return [(0, 0, n, zlib.crc32(_END, zlib.crc32(raw)))]
    view = memoryview(raw + _END)
    return [(k, a, min(capacity, n - a), zlib.crc32(view[4 * a : 4 * (a + capacity)])) for k, a in enumerate(range(0, n, capacity))]


def _pieces(path: str | None, capacity: int) -> Callable:
    """Pieces of rows with a text, or without a path of rows with ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, counts = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            at, doc_ids = 0, batch.column("doc_id")
            groups = map(encoder(path).batch, in_groups(batch.column("text").to_pylist())) if path else ([x.as_py()] for x in batch.column("ids"))
            for ids in groups:
                owners, rows, local = [], [], []
                for k, raw in enumerate(ids, at):
                    cut = cut_pieces(raw, capacity)
                    rows += cut
                    for _, _, length, _ in cut:
                        owners.append(k)
                        local.append(counts[length])
                        counts[length] += 1
                at += len(ids)
                piece, start, length, crc = zip(*rows, strict=True)
                columns = [doc_ids.take(pa.array(owners, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, crc)], pa.array([task] * len(rows), pa.int32()), pa.array(local, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PIECE.split(", ")])
        if path:
            encoder(path).clear()  # workers wait by turns, so each would come to hold words

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, long_chars: int = LONG_CHARS) -> DataFrame:
    """The pieces of all documents, with the task that made each and its number among that task's pieces of equal length.

    Texts above long_chars are encoded in parts, by tree concatenation.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    path, schema, is_long = tokenizer or default_tokenizer(), _PIECE.format(kind=dict(rows.dtypes)["doc_id"]), F.char_length("text") > long_chars
    return rows.where(~is_long).mapInArrow(frees_batches(_pieces(path, capacity)), schema).unionByName(encode_long(rows.where(is_long), path, long_chars).mapInArrow(_pieces(None, capacity), schema))


def pack(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    made = written(pieces(docs, tokenizer, doc_id, text, capacity))  # task and local hold for these rows alone
    by_task = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start_rank"))
    histogram = {r.length: r.n for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    slots = plan_slots(histogram, capacity)
    plan = spark.createDataFrame(slots, _PLAN)
    ranked = made.join(starts, ["length", "task"]).withColumn("rank", F.col("start_rank") + F.col("local"))
    found = ranked.join(F.broadcast(plan), (ranked.length == plan.length) & (ranked["rank"] >= plan.low) & (ranked["rank"] < plan.high))
    ahead = F.col("rank") - F.col("low")
    sequence = F.col("first") + F.floor(ahead / F.col("each"))
    offset = F.col("place") + ahead % F.col("each") * ranked.length
    return found.select("doc_id", "piece", ranked["start"], ranked.length, "ids_crc32", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
