import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from devicelogs.llm import packing as p
from devicelogs.llm.bpe import default_tokenizer, encoder
from devicelogs.llm.query_10 import op10_best_fit_packing


def expand(slots):
    for length, low, high, first, each, place in slots:
        for r in range(low, high):
            yield length, r, first + (r - low) // each, place + (r - low) % each * length


def best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        at = min((r for r in rooms if r >= x), default=None)
        if at is None:
            at = capacity
        else:
            rooms.remove(at)
        rooms.append(at - x)
    return len(rooms)


def check(rows, capacity):
    by = defaultdict(list)
    for length, sequence, offset in rows:
        by[sequence].append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_plan_is_as_good_as_best_fit_over_pieces():
    rng = random.Random(1)
    for capacity in (10, 64, 512):
        for _ in range(40):
            lengths = [rng.randint(1, rng.choice([capacity, capacity // 3 + 1])) for _ in range(rng.randint(1, 300))]
            rows = list(expand(p.plan_slots(dict(Counter(lengths)), capacity)))
            assert Counter(r[0] for r in rows) == Counter(lengths)
            assert {(x, r) for x, r, _, _ in rows} == {(x, r) for x, n in Counter(lengths).items() for r in range(n)}
            assert check([(x, s, o) for x, _, s, o in rows], capacity) <= best_fit(lengths, capacity) + 1
    assert p.plan_slots({}) == []


def test_plan_does_not_grow_with_the_counts():
    small = len(p.plan_slots({n: 10 for n in range(1, 4097)}))
    assert len(p.plan_slots({n: 10**9 for n in range(1, 4097)})) < 4 * small


def test_pack_against_brute_force(spark):
    texts = [None, "", "one", "word " * 9000, "same text", "same text", *[f"w{i} " * (i % 50) for i in range(200)]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(3)
    rows = p.pack(docs).collect()
    coder = encoder(default_tokenizer())
    want = {}
    for i, t in enumerate(texts):
        ids = [*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            want[i, k // 4096] = (k, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    n = check([(r.length, r.sequence_id, r.offset) for r in rows], 4096)
    assert n <= best_fit([x[1] for x in want.values()], 4096) + 1
    assert p.pack(docs.limit(0)).count() == 0
    parts = p.pieces(docs, long_chars=3000).collect()  # most of the long text's tokens come from the tree
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in parts} == want and len(parts) == len(want)
    assert len({(r.length, r.task, r.local) for r in parts}) == len(parts)
    parts = p.pieces(docs.repartition(5), long_chars=3000).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in parts} == want and len(parts) == len(want)
    odd = p.pack(docs.selectExpr("if(doc_id % 2 = 0, null, concat('d', doc_id)) as doc_id", "text")).collect()
    assert len(odd) == len(want) and sum(r.doc_id is None for r in odd) > 90


def test_query(spark):
    rows = op10_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    assert check([(r.length, r.sequence_id, r.offset) for r in rows], 4096) <= 1.02 * sum(r.length for r in rows) / 4096 + 1


def test_a_waiting_worker_holds_no_words(monkeypatch):
    monkeypatch.setattr(p.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    docs = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words", "and more of them"]})
    made = pa.Table.from_batches(p._pieces(default_tokenizer(), 4096)(iter([docs])))
    assert made.column("doc_id").to_pylist() == [1, 2] and not encoder(default_tokenizer()).known
