import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from devicelogs.llm import jaccard_join as j
from devicelogs.llm.common import Scratch
from devicelogs.llm.query_03 import op3_jaccard_join


def brute(docs):
    sets = {}
    for d, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    for a, b in {(a, b) for ds in by.values() for a in ds for b in ds if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 4000)}"
    passage = [word() for _ in range(30)]
    bases = [[word() for _ in range(rng.randint(1, 90))] for _ in range(12)]
    docs = []
    for _ in range(n):
        words = list(rng.choice(bases)) if rng.random() < 0.7 else [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            if words:
                words[rng.randrange(len(words))] = word()
        if rng.random() < 0.4:
            words = passage + words[: rng.randint(0, 12)]
        docs.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in words))
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id long, text string, n_shingles int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.jaccard_components(df).collect()}
    assert got == brute(docs)


def test_overlaps_are_counted_on_whole_hashes(spark, monkeypatch):
    """Shingles that agree in all but the middle bits are different ones, in sets, in frequencies and in overlaps."""

    class Close(j.Shingler):
        def __call__(self, text):
            return np.array(sorted(np.uint64(int(w)) << np.uint64(40) for w in set((text or "").split())), np.uint64)

    monkeypatch.setattr(j, "Shingler", Close)
    sets = {1: range(1, 9), 2: [*range(1, 8), 20], 3: [1, 2, 3, 4, 31, 32, 33, 34], 4: range(40, 48), 5: range(50, 58)}
    df = pd.DataFrame([(d, d, " ".join(map(str, s))) for d, s in sets.items()], columns=["doc_id", "text_hash", "text"])
    batch = [j.pa.RecordBatch.from_pandas(df)]
    monkeypatch.setattr(j.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})()))
    rows = pd.concat([b.to_pandas() for b in j._pack(6)(iter(batch))])
    counted = pd.concat([j._count_bucket(g) for _, g in rows.groupby("bucket")])
    made = pd.concat([j._sets_of_block(g) for _, g in counted.groupby("block")]).set_index("doc_id")
    assert made.n_shingles.to_dict() == {d: 8 for d in sets} and made.tokens[4] is None and made.tokens[5] is None
    both = len(np.intersect1d(*[np.frombuffer(made.tokens[d], "<u8") for d in (1, 2)]))
    assert both == 7 and len(np.frombuffer(made.tokens[1], "<u8")) == 7


def test_odd_rows(spark):
    text = "one two three four five six seven eight"
    rows = [(5, None), (6, ""), (7, " \n"), (8, "a b"), (9, "A  b"), (3, text), (4, text + " nine"), (4, text + " nine"), (None, text), (2, "w " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.jaccard_components(df).collect()), key=str)
    assert got == sorted([(5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 8), (9, 1, 8), (3, 4, 3), (4, 5, 3), (4, 5, 3), (None, 4, None), (2, 1, 2)], key=str)
    assert j.jaccard_components(df.limit(0)).count() == 0


def test_frequent_shingles_travel_as_counts(monkeypatch):
    monkeypatch.setattr(j, "FREQUENT", 3)
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 20).astype(np.uint64) << np.uint64(58) | rng.integers(0, 2, 20).astype(np.uint64)) for _ in range(30)]
    blocks = [j._Block(), j._Block()]
    for k, s in enumerate(sets):
        blocks[k % 2].add(k, 100 + k, s)
    rows = pd.DataFrame([r for n, b in enumerate(blocks) for r in b.rows(n, 6)], columns=["bucket", "block", "kind", "a", "b", "c"])
    assert {j.HOT, j.COLD} <= set(rows.kind)
    counted = pd.concat([j._count_bucket(g) for _, g in rows.groupby("bucket")])
    made = pd.concat([j._sets_of_block(g) for _, g in counted.groupby("block")]).set_index("doc_id")
    df = defaultdict(int)
    for s in {x.tobytes() for x in sets}:
        for x in np.frombuffer(s, np.uint64):
            df[x] += 1
    for k, s in enumerate(sets):
        want = sorted((df[x], int(x)) for x in s if df[x] > 1)
        assert made.n_shingles[k] == len(s)
        if made.tokens[k] is not None:
            assert np.frombuffer(made.tokens[k], "<u8").tolist() == [t for _, t in want]


def test_blocks_pass_the_buckets_apart(monkeypatch):
    monkeypatch.setattr(j, "FREQUENT", 2)
    keys = []
    for block in [k << 32 for k in range(200)] + [(3 << 32) + 1, (3 << 32) + 2]:
        made = j._Block()
        made.add(1, 0, np.arange(9, dtype=np.uint64))
        made.add(2, 0, np.arange(8, dtype=np.uint64))
        keys.append({r[0] for r in made.rows(block, 6) if r[2] in (j.DOCS, j.HOT_REFS)})
    assert all(len(k) == 1 for k in keys) and len(set().union(*keys)) == len(keys)
    assert not set().union(*keys) & set(range(1 << 6))


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op3_jaccard_join(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute(docs)


def test_chain_of_sliding_documents(spark):
    words = [f"w{k}" for k in range(240)]
    docs = [(k, " ".join(words[k : k + 40])) for k in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in j.jaccard_components(df).collect()} == dict.fromkeys(range(200), 0)


def test_paths_and_stars_contract_in_few_rounds(spark):
    rng = random.Random(3)
    names = rng.sample(range(1000, 2000), 200)
    edges = [(k, k + 1) for k in range(200)] + [(a, b) for a, b in zip(names, names[1:])] + [(3000 + k, 5000) for k in range(100)]
    tables = Scratch(spark)
    got = {r.u: r.root for r in j.contract(spark.createDataFrame(edges, "u long, v long"), tables).collect()}
    want = {k: 0 for k in range(1, 201)} | {n: min(names) for n in names if n != min(names)} | {k: 3000 for k in [*range(3001, 3100), 5000]}
    assert got == want
    assert len(tables.paths) < 50  # a step per link would take more than 200


def test_hot_shingles_are_salted(spark, monkeypatch):
    monkeypatch.setattr(j, "HOT_GROUPS", 3)
    docs = corpus(5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.jaccard_components(df).collect()}
    assert got == brute(docs)


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(j, "BUCKET_BITS", (30, 32))
    docs = corpus(6, 60)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(j, "shingle_sets", lambda rows: rows.mapInArrow(j._pack(30), j._PACKED).groupBy(F.expr("bucket % 7")).applyInPandas(lambda g: pd.concat([j._count_bucket(x) for _, x in g.groupby("bucket")]), "block long, kind int, a binary, b binary, c binary").groupBy("block").applyInPandas(j._sets_of_block, j._SETS))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.jaccard_components(df).collect()}
    assert got == brute(docs)


def test_rows_are_judged_by_their_texts(spark):
    x, y, z = (" ".join(f"{c}{k}" for k in range(30)) for c in "xyz")
    rows = [(3, x), (7, x), (7, y), (8, x + " more"), (8, z), (9, z), (9, z), (4, y + " end"), (4, y), (5, ""), (5, ""), (6, None), (None, x), (None, x)]
    docs = spark.createDataFrame([(d, t, "r", d) for d, t in rows], "doc_id long, text string, row string, text_hash long")
    got = {(r.doc_id, r.text, r.component_id) for r in docs.select("doc_id", "text").join(j.jaccard_components(docs), "doc_id").collect() if r.doc_id == 3}
    assert got == {(3, x, 3)}
    kept = j.drop_near_copies(docs)
    assert kept.columns == docs.columns
    rest = sorted(((r.doc_id or 0, r.text or "-") for r in kept.collect()))
    of = lambda d: [t for i, t in rest if i == d]
    assert of(3) == [x] and of(7) == [] and of(8) == [z] and of(9) == [] and len(of(4)) == 1 and of(5) == ["-"] and of(6) == ["-"] and of(0) == [x, x]
    assert j.drop_near_copies(spark.createDataFrame([(3, x), (7, x), (7, "q w e r t y u")], "doc_id long, text string")).count() == 2
    assert j.drop_near_copies(docs.limit(0)).count() == 0
