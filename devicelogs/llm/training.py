"""Labelled rows to learn from, and a logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, bound: int) -> DataFrame:
    """doc_id, text and label of at most ``bound`` labelled rows outside of the held-out fold, chosen by a hash of doc_id.

    Rows without a label don't count; of several labels of a document the largest counts, of several texts the first in their order.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)  # the bound holds for what is broadcast, too
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def logistic_fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights of a logistic model with a Gaussian prior, by Newton steps."""
    w = prior.astype(float).copy()
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + strength * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(strength)
        step = np.linalg.solve(curve, slope)
        size = np.abs(step).max()
        w -= step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-9:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
