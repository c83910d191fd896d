import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from devicelogs.llm import periodic_runs as p
from devicelogs.llm.query_13 import op13_periodic_runs


def brute_runs(words):
    """Runs by trying all periods: maximal stretches of words[i] == words[i + q], whose smallest period is q."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            smaller = any(all(words[k] == words[k + x] for k in range(i, i + length - x)) for x in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        q = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % q] for i in range(a, n)]
    runs = brute_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(runs), *best, runs and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(kept))


def fast_runs(words):
    made = p._together([[str(w).encode() for w in words]], p.LEAST, p.EXPONENT)[0]
    a = np.array(words, np.int64)
    spans = p.regions(p.next_triples(a, np.zeros(len(a), np.int64)), np.zeros(len(a), np.int64)) if len(a) else []
    runs = p.runs_within(a, [(x, min(y, len(a))) for x, y in spans])
    assert made[0] == len(runs)
    return runs


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 7)), max_size=8))
def test_runs_equal_brute_force(parts):
    words = [w for block, times in parts for w in block * times]
    assert fast_runs(words) == brute_runs(words)


@pytest.mark.parametrize("seed", range(6))
def test_longer_texts(seed):
    rng = random.Random(seed)
    words = []
    while len(words) < 1500:
        block = [rng.randint(0, [2, 30][seed % 2]) for _ in range(rng.randint(1, 60))]
        words += block * rng.choice([1, 1, 2, 4, 5]) + block[: rng.randint(0, len(block))]
    assert fast_runs(words) == brute_runs(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=2, max_size=40))
def test_suffix_order(words):
    order, shared = p.suffix_order(np.array(words))
    assert order.tolist() == sorted(range(len(words)), key=lambda k: words[k:])
    for k in range(1, len(words)):
        a, b = words[order[k - 1] :], words[order[k] :]
        assert shared[k - 1] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_classes_give_neighbours():
    rng = random.Random(3)
    order = np.array(rng.sample(range(60), 60))
    classes, sets = p.Classes(order), [{x} for x in order.tolist()]
    for k in rng.sample(range(59), 59):
        a, b = (next(s for s in sets if int(order[x]) in s) for x in (k, k + 1))
        both = sorted(a | b)
        assert set(classes.unite(k, k + 1)) == {(x, y) for x, y in zip(both, both[1:]) if (x in a) != (y in a)}
        sets = [s for s in sets if s is not a and s is not b] + [a | b]


def test_one_word_many_times_is_linear():
    words = np.zeros(60_000, np.int64)
    assert p.runs_within(words, [(0, len(words))]) == [(0, 60_000, 1)]


def got(r):
    return (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)


def test_spark_handling(spark, monkeypatch):
    monkeypatch.setattr(p, "BATCH_BYTES", 300)
    texts = [None, "", "   ", "a a a a a a", "a\x0bb\x1cb a" * 9, "é " * 7 + "x y " * 4 + "tail", "one two three " * 40] + [f"w{k % 3} v{k % 7} " * (k % 12) for k in range(60)]
    docs = spark.createDataFrame([(k, t, 1, "n") for k, t in enumerate(texts)] + [(3, texts[3], 1, "n"), (None, texts[4], 1, "n")], "doc_id long, text string, start int, named string")
    for rows in (docs, docs.repartition(3)):
        found = p.periodic_runs(rows, stretch=True).selectExpr("*", "sha2(collapsed, 256) as collapsed_sha256").collect()
        assert sorted((str(r.doc_id), got(r)) for r in found) == sorted((str(r.doc_id), brute_row(r.doc_id, r.text)) for r in docs.collect())
    assert p.periodic_runs(docs.limit(0)).count() == 0
    text_ids = p.periodic_runs(docs.selectExpr("concat('d', doc_id) as doc_id", "text"), stretch=True).where("doc_id = 'd6'").collect()
    assert text_ids[0].doc_id == "d6"


def test_query_on_the_small_tables(spark):
    found = {r.doc_id: got(r) for r in op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(found) == len(docs) and sum(x[0] > 0 for x in found.values()) > 5
    for r in docs:
        if len(r.text or "") < 6000:
            assert found[r.doc_id] == brute_row(r.doc_id, r.text)
