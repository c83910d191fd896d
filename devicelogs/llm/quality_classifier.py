"""A quality classifier: naive Bayes support vectors over n-gram indicators.

Features are indicators of hashed n-grams: words and word pairs, and one to three shapes in a row (how a word is cased, how it ends,
whether it repeats the word before). Each indicator is scaled by its class log-count ratio, and a linear hinge-loss model is fitted to the
scaled indicators by dual coordinate descent. A part of the sample calibrates the margin to a probability.

The model is fitted in one task on a sample of at most TRAIN_ROWS labelled rows; the weights, one number per hash bucket, are broadcast and
score every document. Null text counts as empty, and a text of any length is scored whole. Equal texts get equal scores, whatever the doc_id;
further columns pass through. Of labelled rows with one doc_id the first text in order is learnt from. Without labelled rows of both classes
every score is the share of label 1 (0.5 without any); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frees_batches
from .training import labelled_sample, logistic_fit, sigmoid

FOLDS, FOLD = 3, 1
#: Most labelled rows that a model is fitted on.
TRAIN_ROWS = 12_000
BUCKETS = 1 << 18
#: Pseudo-count of the ratios, cost of a unit of hinge loss, share of the plain mean weight.
ALPHA, COST, MEAN_SHARE = 1.0, 10.0, 0.25
#: Passes over the sample end where no dual could gain more than this, or after so many.
TOLERANCE, PASSES = 0.05, 12
THRESHOLD = 0.5
_CACHED = 200_000


class Features:
    """Texts to sorted hash buckets; keeps the words it has met."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def _word(self, word: str) -> tuple[int, int]:
        core = word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        end = word[len(word.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")) :][:4] if core else word[:4]
        case = "0" if not core else "9" if core[0].isdigit() else "U" if len(core) > 1 and core.isupper() else "C" if core[0].isupper() else "l"
        shape = f"{case}{min(len(core), 12) // 3}{end}"
        found = (xxhash.xxh3_64_intdigest(word.lower()), xxhash.xxh3_64_intdigest(shape, seed=1))
        if len(self.known) >= _CACHED:
            self.known.clear()
        self.known[word] = found
        return found

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        if not words:
            return np.zeros(1, np.int32)
        get, make = self.known.get, self._word
        pairs = [get(w) or make(w) for w in words]
        both = np.array(pairs, np.uint64)
        w, s = both[:, 0], both[:, 1]
        one, two, three = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
        parts = [w, w[:-1] * one + w[1:], s, s[:-1] * two + s[1:], (s[:-2] * two + s[1:-1]) * three + s[2:]]
        same = (w[1:] == w[:-1]).astype(np.uint64)
        parts.append(np.array([same.mean() * 8 if len(same) else 0], np.float64).astype(np.uint64) + np.uint64(77))  # eighths of repeats
        parts.append(np.array([int(np.log2(len(words))) + 99], np.uint64))
        mixed = np.concatenate(parts)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * one
        return np.unique((mixed >> np.uint64(46)).astype(np.int32))


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log-count ratio of each bucket."""
    counts = [np.full(BUCKETS, ALPHA), np.full(BUCKETS, ALPHA)]
    for row, label in zip(rows, y, strict=True):
        counts[label][row] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float = COST, passes: int = PASSES, tolerance: float = TOLERANCE, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model with the least half squared norm (bias included) plus cost times hinge loss."""
    rng = np.random.default_rng(seed)
    w, bias, duals = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    sign = np.where(y == 1, 1.0, -1.0)
    norms = np.array([v @ v + 1.0 for v in values])
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            slope = sign[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(duals[i] - slope / norms[i], 0.0), cost)
            if new != duals[i]:
                worst = max(worst, abs(slope))  # it isn't at a bound that the slope points out of
                step = (new - duals[i]) * sign[i]
                w[rows[i]] += step * values[i]
                bias += step
                duals[i] = new
        if worst < tolerance:
            break
    return w, bias


def fit(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float, float, float, np.ndarray]:
    """Weights per bucket, bias, the calibration's slope and level, and the ratios per bucket.

    The fifth of the rows that calibrates is in neither the ratios nor the weights, so its margins are those of unseen texts.
    """
    share = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        level = np.log(max(share, 0.01) / max(1 - share, 0.01))
        return np.zeros(BUCKETS), 0.0, 0.0, float(level), np.zeros(BUCKETS)
    test = np.arange(len(rows)) % 5 == 0 if len(rows) >= 50 else np.zeros(len(rows), bool)
    train = np.flatnonzero(~test)
    r = ratios([rows[i] for i in train], y[train])
    unit = [(r[row] / max(np.sqrt((r[row] ** 2).sum()), 1e-9)).astype(np.float32) for row in rows]
    w, bias = dual_coordinate_descent([rows[i] for i in train], [unit[i] for i in train], y[train])
    mean = np.abs(w).sum() / max((w != 0).sum(), 1)
    w = (1 - MEAN_SHARE) * w + MEAN_SHARE * mean * np.sign(w)
    used = np.flatnonzero(test) if test.any() and len(set(y[test].tolist())) == 2 else train
    margin = np.array([w[rows[i]] @ unit[i] + bias for i in used])
    slope, level = logistic_fit(np.column_stack([margin, np.ones(len(margin))]), y[used].astype(float), np.array([1.0, 0.0]), np.array([1e-2, 1e-2]))
    return w, bias, float(slope), float(level), r


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of rows (text, label) in their order; none without rows. Of each batch only the buckets and labels are kept."""
    make, rows, labels = Features(), [], []
    for batch in batches:
        rows += [make(text.as_py()) for text in batch.column("text")]
        labels += batch.column("label").to_pylist()
    make.known.clear()
    if rows:
        w, bias, slope, level, r = fit(rows, np.array(labels, np.int64))
        blob = np.concatenate([w, r, [bias, slope, level]]).astype("<f4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["model"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, fold: int = FOLD, rows: int = TRAIN_ROWS) -> bytes:
    """The model as bytes: weights and ratios per bucket, bias, slope and level."""
    sample = labelled_sample(docs, labels, label, folds, fold, rows).repartition(1).sortWithinPartitions("doc_id")  # at most ``rows`` documents in one task
    made = sample.select("text", "label").mapInArrow(frees_batches(_fit_rows), "model binary").first()
    if made is None:
        return np.zeros(2 * BUCKETS + 3, "<f4").tobytes()
    return bytes(made.model)


def _score(model, column: str, of: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.frombuffer(model.value, "<f4").astype(np.float64)
        w, r, (bias, slope, level) = numbers[:BUCKETS], numbers[BUCKETS : 2 * BUCKETS], numbers[2 * BUCKETS :]
        product, squares, make = w * r, r * r, Features()
        for batch in batches:
            margins = np.empty(len(batch))
            for k, text in enumerate(batch.column(of)):
                row = make(text.as_py() or "")
                margins[k] = product[row].sum() / max(np.sqrt(squares[row].sum()), 1e-9) + bias
            score = sigmoid(slope * margins + level)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, column])

    return run


def score(docs: DataFrame, model: bytes, column: str = "score", text: str = "text") -> DataFrame:
    """docs with one more column: the probability of label 1. docs must have no column of its name."""
    if column.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {column}; choose another name")
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 * BUCKETS + 3 floats
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(frees_batches(_score(held, column, text)), f"{schema}, `{column}` double")
