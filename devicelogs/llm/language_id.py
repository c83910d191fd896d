"""Language identification by the code length of a text under one byte model for each language (prediction by partial matching).

Words (between ASCII white space, lower-cased, as UTF-8) are coded byte by byte, each with the space after it. The context of a byte is up to
ORDER bytes before it and reaches back to the space before the word. Where a byte was never seen after a context, an escape is coded and the
next shorter context tried, without the bytes that the longer one would have coded (exclusion); below the empty context all bytes left are
alike. With d distinct bytes among n after a context the escape has probability d / (n + d). The statistics are frozen: coding changes no
count, so the cost of a byte depends on its window alone, which is the byte with its context. Each worker keeps the costs of the windows it
has met and sums them over a text. Costs are whole numbers of 1 / UNIT bit, so sums are exact and don't depend on their order. The language
with the least cost is predicted, of equals the first by name.

The model is fitted on a bounded sample: in each language the PER_LANGUAGE documents with the smallest hash of their doc_id, outside of the
held-out fold; contexts seen once are left out, but for the empty one. Spark counts windows by
language and then the contexts in them.

Null text, and text without a letter, is ``und`` with score 0, and so is every row if nothing can be learnt. Rows are scored by their texts
alone; a null doc_id is not held out and is never learnt from. Repeated rows get equal results and are learnt from as often as they occur, together or not at all.
Other columns are not read. Texts of any length are scored whole. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, held_out, written

#: Documents that a language is learnt from, at most.
PER_LANGUAGE = 2_000
ORDER = 4
FOLDS, HELD_OUT = 4, 2
UNIT = 1 << 16
UNDETERMINED = "und"
#: Code points whose windows are held at once, or one text.
BATCH_CHARS = 1_000_000
#: Costs (windows times languages) that a worker keeps.
CACHED_COSTS = 1 << 22
#: More languages than this are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000

_LETTER = re.compile(r"[^\W\d_]")
_SPACE = 0x20
_FIELD = 9
_MASK = (1 << _FIELD) - 1
#: Bytes as they are, and a space for each byte of white space.
_PLAIN = np.array([_SPACE if bytes([b]) in SPACES else b for b in range(256)], np.uint8)

Counts = dict[bytes, dict[int, int]]  # by context: how often each byte followed


# Code lengths


def windows(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all coded bytes and how many each text has. A window is a number of FIELD bits for the byte (one more than it), then the byte before it and so on."""
    parts = [b" %b " % t.lower().encode() for t in texts]
    raw = _PLAIN[np.frombuffer(b"".join(parts), np.uint8)]
    begins = np.cumsum([0, *map(len, parts)])[:-1]
    space = raw == _SPACE
    kept = ~space
    kept[1:] |= ~space[:-1]
    kept[begins] = True  # each text has one space before its first word
    sizes = np.add.reduceat(kept, begins, dtype=np.int64)
    raw, space = raw[kept], space[kept]
    value, inside = raw.astype(np.int64) + 1, np.ones(len(raw), bool)
    found = value.copy()
    for k in range(1, order + 1):
        before = np.zeros(len(raw), np.int64)
        before[k:] = value[:-k] << (_FIELD * k)
        found |= np.where(inside, before, 0)
        inside[k:] &= ~space[:-k]  # a context ends at the space before the word
    coded = np.ones(len(raw), bool)
    coded[np.cumsum([0, *sizes])[:-1]] = False
    return found[coded], sizes - 1


def unpacked(window: int) -> tuple[bytes, int]:
    """Context and byte of a window."""
    byte, context = (window & _MASK) - 1, []
    while window := window >> _FIELD:
        context.append((window & _MASK) - 1)
    return bytes(context[::-1]), byte


def cost(counts: Counts, context: bytes, byte: int) -> int:
    """Code length of a byte in 1 / UNIT bit."""
    total, excluded = 0.0, set()
    while True:
        after = counts.get(context)
        seen = {b: n for b, n in after.items() if b not in excluded} if after and excluded else after
        if seen:
            size, distinct = sum(seen.values()), len(seen)
            if byte in seen:
                return round((total - math.log2(seen[byte] / (size + distinct))) * UNIT)
            total -= math.log2(distinct / (size + distinct))
            excluded.update(seen)
        if not context:
            return round((total + math.log2(256 - len(excluded))) * UNIT)
        context = context[1:]


class Model:
    """Languages and their counts."""

    def __init__(self, rows: list[tuple[str, bytes, int, int]], order: int = ORDER):
        by: dict[str, Counts] = defaultdict(lambda: defaultdict(dict))
        for language, context, byte, n in rows:
            by[language][bytes(context)][byte] = n
        self.order, self.languages = order, sorted(by)
        self.counts = [dict(by[x]) for x in self.languages]


class Scorer:
    """A model with the costs of the windows met so far: most in a table by a hash of the window, those whose place is taken in a sorted list."""

    def __init__(self, model: Model):
        self.model, self.bits = model, max(8, (CACHED_COSTS // (len(model.languages) + 2)).bit_length() - 1)
        self.forget()

    def forget(self) -> None:
        n = len(self.model.languages)
        self.keys, self.table = np.zeros(1 << self.bits, np.int64), np.zeros((1 << self.bits, n), np.int32)
        self.others, self.costs, self.size = np.zeros(0, np.int64), np.zeros((0, n), np.int32), 0

    def _places(self, found: np.ndarray) -> np.ndarray:
        return ((found.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def learn(self, found: np.ndarray) -> None:
        """Computes the costs of distinct windows."""
        new = found[~np.isin(found, self.others)]
        if not len(new):
            return
        orders = [[cost(c, context, byte) for c in self.model.counts] for context, byte in map(unpacked, new.tolist())]
        made, places = np.array(orders, np.int32), self._places(new)
        first = np.zeros(len(new), bool)
        first[np.unique(places, return_index=True)[1]] = True
        first &= self.keys[places] == 0
        self.keys[places[first]], self.table[places[first]] = new[first], made[first]
        others, costs = np.concatenate([self.others, new[~first]]), np.concatenate([self.costs, made[~first]])
        order = np.argsort(others)
        self.others, self.costs, self.size = others[order], costs[order], self.size + len(new)

    def totals(self, texts: list[str]) -> np.ndarray:
        """The cost of each text in each language."""
        found, sizes = windows(texts, self.model.order)
        places = self._places(found)
        missed = np.flatnonzero(self.keys[places] != found)
        if len(missed):
            self.learn(np.unique(found[missed]))
            missed = missed[self.keys[places[missed]] != found[missed]]
        ends, made = np.cumsum(sizes), []
        rest = np.searchsorted(self.others, found[missed])
        for k in range(len(self.model.languages)):
            each = self.table[places, k]
            each[missed] = self.costs[rest, k]
            upto = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
            made.append(upto[ends] - upto[ends - sizes])
        if self.size > 1 << self.bits:
            self.forget()
        return np.array(made).T

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Of each text the language and its share of the probability of the text, all languages alike before."""
        found = [(UNDETERMINED, 0.0)] * len(texts)
        chosen = [k for k, t in enumerate(texts) if t and _LETTER.search(t)] if self.model.languages else []
        if chosen:
            totals = self.totals([texts[k] for k in chosen])
            best = totals.argmin(axis=1)
            share = 1 / np.exp2(np.clip((totals.min(axis=1, keepdims=True) - totals) / UNIT, -1000, 0)).sum(axis=1)
            for k, b, x in zip(chosen, best.tolist(), share.tolist(), strict=True):
                found[k] = self.model.languages[b], x
        return found


def _grouped(texts: list[str | None]) -> Iterator[list[str | None]]:
    group, size = [], 0
    for text in texts:
        if group and size + len(text or "") > BATCH_CHARS:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text or "")
    if group:
        yield group


# Spark


def sample(docs: DataFrame, bound: int = PER_LANGUAGE) -> DataFrame:
    """lang and text of the rows that are learnt from: those with the smallest hashes of their language, as many as the bound takes. Rows of one
    doc_id go together; if they are more than the bound by themselves, they and all behind them stay out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    rows = known.select("lang", F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    sizes = written(rows.groupBy("lang").agg(F.count("*").alias("size")))
    small = sizes.count() <= BROADCAST_LANGUAGES
    by_language = lambda df, other: df.join(F.broadcast(other) if small else other, "lang")
    share = (F.col("h") / 2.0**64 + 0.5) * F.col("size") <= 2 * bound  # hashes are even: about twice the bound stays to be ordered
    hashes = by_language(rows.select("lang", "h"), sizes).where(share).groupBy("lang", "h").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("h"))
    last = written(hashes.withColumn("upto", upto).where(F.col("upto") <= bound).groupBy("lang").agg(F.max("h").alias("last")))
    return by_language(rows, last).where("h <= last and text is not null").select("lang", "text")


def _count_windows(order: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = defaultdict(list)
            for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by[language].append(text)
            for language, texts in by.items():
                for group in _grouped(texts):
                    distinct, n = np.unique(windows(group, order)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([language] * len(distinct), pa.string()), pa.array(distinct), pa.array(n, pa.int64())], names=["lang", "window", "n"])

    return run


def _count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for language, window, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "window", "n")), strict=True):
            context, byte = unpacked(window)
            for k in range(len(context) + 1):
                counts[language, context[k:], byte] += n
        language, context, byte = zip(*counts, strict=True) if counts else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(language, pa.string()), pa.array(context, pa.binary()), pa.array(byte, pa.int32()), pa.array(counts.values(), pa.int64())], names=["lang", "context", "byte", "n"])


def count_contexts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, context, byte, n of rows (lang, text)."""
    found = rows.mapInArrow(_count_windows(order), "lang string, window long, n long").groupBy("lang", "window").agg(F.sum("n").alias("n"))
    counted = found.mapInArrow(_count_contexts, "lang string, context binary, byte int, n long").groupBy("lang", "context", "byte").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") > 1) | (F.length("context") == 0))


def train(docs: DataFrame, bound: int = PER_LANGUAGE, order: int = ORDER) -> Model:
    """The model of a bounded sample; what comes to the driver is the distinct contexts of that sample."""
    return Model([tuple(r) for r in count_contexts(sample(docs, bound), order).collect()], order)


@lru_cache(maxsize=1)
def _scorer(shared) -> Scorer:
    return Scorer(shared.value)


def _score(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            found = [x for group in _grouped(batch.column("text").to_pylist()) for x in scorer.predict(group)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    kind, shared = dict(docs.dtypes)["doc_id"], docs.sparkSession.sparkContext.broadcast(model)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_score(shared), f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score")
