import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from devicelogs.llm import quality_classifier as q
from devicelogs.llm.query_08 import op8_quality_classifier


def test_ratios_and_solver():
    rows = [np.array([0, 1]), np.array([0, 2]), np.array([3, 4]), np.array([3, 5])]
    y = np.array([1, 1, 0, 0])
    r = q.ratios(rows, y)
    assert r[0] > 0 > r[3] and abs(r[0] + r[3]) < 1e-9
    w, b = q.dual_coordinate_descent(rows, [np.ones(2)] * 4, y, cost=10.0, passes=50)
    assert all((w[x].sum() + b > 0.9) == bool(t) for x, t in zip(rows, y))
    assert q.fit([], np.zeros(0, int))[2] == 0 and q.fit(rows[:2], y[:2])[3] > 3


def test_solver_reaches_the_least_loss():
    rng = np.random.default_rng(4)
    n, m, cost = 60, 12, 0.7
    rows = [np.sort(rng.choice(m, 5, replace=False)) for _ in range(n)]
    values = [rng.normal(size=5) for _ in rows]
    y = np.array([int(v.sum() + rng.normal() > 0) for v in values])
    w, b = q.dual_coordinate_descent(rows, values, y, cost, 4000, 1e-9)
    x = np.zeros((n, m + 1))
    for k, (r, v) in enumerate(zip(rows, values)):
        x[k, r], x[k, m] = v, 1.0
    sign = np.where(y == 1, 1.0, -1.0)
    loss = lambda u: 0.5 * u @ u + cost * np.maximum(0, 1 - sign * (x @ u)).sum()
    found, slow = np.concatenate([w[:m], [b]]), np.zeros(m + 1)
    best = loss(slow)
    for k in range(1, 60_000):  # sub-gradient steps on the loss itself
        slow = slow - (slow - cost * (x * sign[:, None])[sign * (x @ slow) < 1].sum(0)) / k
        best = min(best, loss(slow))
    assert loss(found) <= best + 1e-6 and best - loss(found) < 0.01 * best


def test_calibration_rows_are_unseen():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 200)
    rows = [np.unique(np.concatenate([rng.integers(0, 50, 5) + 50 * t, [1000 + k]])) for k, t in enumerate(y)]
    *_, r = q.fit(rows, y)
    assert all((len({r[1000 + k], r[999]}) == 1) == (k % 5 == 0) for k in range(200))  # a bucket of one calibration row has the ratio of no row
    kept = [k for k in range(200) if k % 5]
    assert np.allclose(r, q.ratios([rows[k] for k in kept], y[kept]))


def test_scores_against_plain_arithmetic(spark):
    texts = [(k, f"{'good fine' if k % 2 else 'bad poor'} words {k} and more of them") for k in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = q.train(docs, spark.createDataFrame([(k, k % 2) for k, _ in texts], "doc_id long, quality int"))
    numbers = np.frombuffer(model, "<f4").astype(float)
    w, r, (bias, slope, level), make = numbers[: q.BUCKETS], numbers[q.BUCKETS : -3], numbers[-3:], q.Features()
    for row in q.score(docs, model).collect():
        found = [int(k) for k in make(row.text)]
        norm = sum(r[k] ** 2 for k in found) ** 0.5
        margin = sum(w[k] * r[k] / norm for k in found) + bias
        assert abs(row.score - 1 / (1 + np.exp(-(slope * margin + level)))) < 1e-6


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op8_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [d for d in labels if got[d].held_out]
    assert len(held) > 80 and np.mean([got[d].predicted == labels[d] for d in held]) > 0.95
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark):
    rows = [(None, None, "x"), (1, "", "x"), (2, "same words", "x"), (2, "same words", "x"), (3, "long " * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, None), (None, 1), (77, 1)], "doc_id long, quality int")
    got = q.score(docs, q.train(docs, labels)).collect()
    assert len(got) == 5 and len({r.score for r in got if r.text == "same words"}) == 1
    empty = q.score(docs.limit(0), q.train(docs.limit(0), labels.limit(0)))
    assert empty.count() == 0
    assert {r.score for r in q.score(docs, q.train(docs, labels.limit(0))).collect()} == {0.5}
    with pytest.raises(ValueError):
        q.score(docs, q.train(docs, labels), "label")
    assert q.score(docs.withColumnRenamed("label", "_score"), q.train(docs, labels)).columns == ["doc_id", "text", "_score", "score"]
    twice = [spark.createDataFrame(x, "doc_id long, text string") for x in ([(1, "a b"), (1, "c d"), (2, "e")], [(2, "e"), (1, "c d"), (1, "a b")])]
    assert q.train(twice[0], labels) == q.train(twice[1], labels)


def test_fitting_does_not_hold_the_texts():
    texts = ((word * 1000 + " ") * 100 for word in ["good_", "poor_"] * 100)  # 100 MB
    batches = (pa.RecordBatch.from_pydict({"text": [t], "label": [int(t[0] == "g")]}) for t in texts)
    made = q._fit_rows(batches)
    q.Features()("numpy is loaded")
    tracemalloc.start()
    (model,) = made
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    numbers = np.frombuffer(model.column("model")[0].as_py(), "<f4")
    assert len(numbers) == 2 * q.BUCKETS + 3 and peak < 60_000_000
    assert not list(q._fit_rows(iter([])))
