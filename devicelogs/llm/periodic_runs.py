"""Periodic runs of words, by Kruskal's order on the suffix array of a text.

A run is a stretch of consecutive words with smallest period q and at least max(LEAST, EXPONENT * q) words, which neither neighbour extends.

Two suffixes belong to one class once their common prefix is as long as the level at hand. Classes are united by decreasing length of the
common prefix with union-find; each keeps its positions in order. When two classes unite, positions of one that become neighbours of
positions of the other share exactly the level's number of words. If their distance is at most that, the stretch from the first of them is
periodic, and with no word before it that keeps the period it is a run. Every run is found so: its first word and the word one period later
become neighbours at the level of their common prefix, as a position between them would give a smaller period.

Before that, words that can't be in a run are left out. Inside a run the next occurrence of a word triple is at most q words away, for at
least 3q - 2 triples in a row (and 3 of them at least), so stretches of triples that come again are cut where the next one is too far for
the length of the stretch, until none is left to cut. Nothing is lost by that; only what is left goes through the suffix array.

Null text counts as no words: no runs, and empty texts for both hashes. Rows are judged by their texts, each for itself, so repeated rows get
equal results; doc_id keeps its type, a null doc_id alters nothing, and other columns are not read. Texts of any length are read whole. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewest words of a run, and fewest periods.
LEAST = 6
EXPONENT = 4
#: Bytes of text whose words are held at once, or one text.
BATCH_BYTES = 4_000_000
#: Rounds of cutting; more would only leave out more.
ROUNDS = 64

Run = tuple[int, int, int]  # start, length, period


class _Numbered(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


# Suffixes


def suffix_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in their order, and of each but the first the words that it shares with the one before. Ranks double their reach each round."""
    n = len(words)
    ranks = [np.unique(words, return_inverse=True)[1].astype(np.int32)]
    reach = 1
    while reach < n and ranks[-1].max() < n - 1:
        key = ranks[-1].astype(np.int64) * (n + 1)
        key[:-reach] += ranks[-1][reach:] + 1
        ranks.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
        reach *= 2
    order = np.argsort(ranks[-1], kind="stable")
    left, right = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = np.flatnonzero((left < n) & (right < n))
        same = inside[ranks[k][left[inside]] == ranks[k][right[inside]]]
        for x in (left, right, shared):
            x[same] += 1 << k
    return order, shared


class Classes:
    """Union-find over places of the suffix order; each class keeps its positions in order."""

    def __init__(self, order: np.ndarray):
        self.parent = list(range(len(order)))
        self.positions: list[list[int]] = [[p] for p in order.tolist()]

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def unite(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """Unites the classes of two places; yields the positions, one of each class, that have become neighbours."""
        a, b = self.find(a), self.find(b)
        if len(self.positions[a]) < len(self.positions[b]):
            a, b = b, a
        large, small = self.positions[a], self.positions[b]
        self.parent[b], self.positions[b] = a, []
        before = -1
        for p, after in zip(small, [*small[1:], None], strict=True):
            at = bisect_left(large, p)
            if at and large[at - 1] > before:
                yield large[at - 1], p
            if at < len(large) and (after is None or large[at] < after):
                yield p, large[at]
            before = p
        if len(small) > 8:
            large += small
            large.sort()  # two ascending parts: merged
        else:
            for p in small:
                insort(large, p)


def seeds(words: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> Iterator[tuple[int, int, int]]:
    """(position, distance, words shared) of neighbours whose distance and common prefix make a long enough periodic stretch."""
    if len(words) < 2:
        return
    order, shared = suffix_order(words)
    classes = Classes(order)
    enough = np.flatnonzero(shared >= exponent - 1)
    for k in enough[np.argsort(-shared[enough], kind="stable")].tolist():
        level = int(shared[k])
        for a, b in classes.unite(k, k + 1):
            if b - a <= level and b - a + level >= max(least, exponent * (b - a)):
                yield a, b - a, level


# Texts


def next_triples(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Per position the distance to the next occurrence of its three words in the same text; 0 without one."""
    n = len(words)
    away = np.zeros(n, np.int64)
    if n < 3:
        return away
    mixed = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    triple = (mixed[:-2] * np.uint64(31) + (mixed[1:-1] ^ (mixed[1:-1] >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9) + (mixed[2:] ^ (mixed[2:] >> np.uint64(31)))
    order = np.argsort(triple, kind="stable")  # triples that only look alike make the distance smaller, and so leave more in
    here, there = order[:-1], order[1:]
    same = (triple[here] == triple[there]) & (doc[here] == doc[there]) & (doc[here] == doc[here + 2])
    away[here[same]] = there[same] - here[same]
    return away


def regions(away: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """Stretches that hold all runs with a period of at most a fourth of them: [start, end)."""
    hot = away > 0
    for _ in range(ROUNDS):
        edge = np.diff(np.concatenate([[0], hot.view(np.int8), [0]]))
        edge[1:-1][(doc[1:] != doc[:-1]) & hot[1:] & hot[:-1]] = 2  # one text ends and the next begins
        starts, ends = np.flatnonzero((edge == 1) | (edge == 2)), np.flatnonzero((edge == -1) | (edge == 2))
        length = ends - starts
        farthest = np.where(length < 3, 0, (length + 2) // 3)
        limit = np.zeros(len(away), np.int64)
        limit[hot] = np.repeat(farthest, length)
        kept = hot & (away <= limit)
        if kept.sum() == hot.sum():
            return [(a, b + f + 2) for a, b, f in zip(starts.tolist(), ends.tolist(), farthest.tolist(), strict=True)]
        hot = kept
    return [(a, b + f + 2) for a, b, f in zip(starts.tolist(), ends.tolist(), farthest.tolist(), strict=True)]


def runs_within(words: np.ndarray, spans: list[tuple[int, int]], least: int = LEAST, exponent: int = EXPONENT) -> list[Run]:
    """The runs of one text, which lie in the spans; by start, then period."""
    n, found = len(words), set()
    for begin, end in spans:
        for at, q, shared in seeds(words[begin:end], least, exponent):
            start, stop = begin + at, begin + at + q + shared
            if start and words[start - 1] == words[start - 1 + q]:
                continue  # the run's first word gives it
            while stop < n and words[stop] == words[stop - q]:
                stop += 1
            found.add((start, stop - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretched(words: list[bytes], doc_id: str | None) -> np.ndarray | None:
    """Places that the words of a stretched row are taken from: for one in ten doc_ids the words from a place on repeat with a period."""
    h = zlib.crc32(doc_id.encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def _result(words: list[bytes], runs: list[Run]) -> tuple:
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    start, length, period = best or (None, None, None)
    listed = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
    if runs:
        covered = np.zeros(len(words) + 1, np.int64)
        for s, m, q in runs:
            covered[s + q] += 1
            covered[s + m] -= 1
        words = [w for w, c in zip(words, np.cumsum(covered[:-1]).tolist(), strict=True) if not c]
    return len(runs), start, length, period, best and 1000 * length // period, listed, b" ".join(words)


_FOUND = "doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed string"


def _together(texts: list[list[bytes]], least: int, exponent: int) -> list[tuple]:
    """Results of several texts, whose words are looked at together."""
    numbers = _Numbered()
    words = np.fromiter((numbers[w] for t in texts for w in t), np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    doc, ends = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes)
    spans: dict[int, list[tuple[int, int]]] = {}
    for a, b in regions(next_triples(words, doc), doc) if len(words) else []:
        spans.setdefault(int(doc[a]), []).append((a, b))
    made = []
    for k, t in enumerate(texts):
        begin, end = int(ends[k] - sizes[k]), int(ends[k])
        made.append(_result(t, runs_within(words[begin:end], [(a - begin, min(b, end) - begin) for a, b in spans.get(k, [])], least, exponent)))
    return made


def _grouped(rows: list[tuple[str | None, bytes]]) -> Iterator[list[tuple[str | None, bytes]]]:
    group, size = [], 0
    for row in rows:
        if group and size + len(row[1]) > BATCH_BYTES:
            yield group
            group, size = [], 0
        group.append(row)
        size += len(row[1])
    if group:
        yield group


def _find(stretch: bool, least: int, exponent: int, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            rows = zip(batch.column("named").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True)
            for group in _grouped([(d, t or b"") for d, t in rows]):
                texts = []
                for named, text in group:
                    words = text.split()  # at space and the five control characters after it
                    places = stretched(words, named) if stretch else None
                    texts.append(words if places is None else [words[p] for p in places.tolist()])
                columns = list(zip(*_together(texts, least, exponent), strict=True))
                made = [batch.column("doc_id").slice(at, len(group)), *[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.string()), pa.array([x.decode() for x in columns[6]], pa.string())]
                at += len(group)
                yield pa.RecordBatch.from_arrays(made, names=names)

    return run


def periodic_runs(docs: DataFrame, stretch: bool = False, least: int = LEAST, exponent: int = EXPONENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_runs, the strongest run (greatest length by period; then smallest start, then period), the hash of the list of runs, and the
    collapsed text: of each run only the first period stays. With ``stretch`` one in ten rows is made periodic first. exponent is 4 or more."""
    if exponent < EXPONENT or least < LEAST:
        raise ValueError(f"the cutting of stretches holds for runs of {EXPONENT} periods and {LEAST} words at least")
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{doc_id}`").cast("string").alias("named"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = _FOUND.format(kind=kind)
    return rows.mapInArrow(_find(stretch, least, exponent, [c.split()[0] for c in schema.split(", ")]), schema)
