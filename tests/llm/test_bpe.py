import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from devicelogs.llm import bpe
from devicelogs.llm.query_09 import op9_bpe_round_trip

CODER = bpe.encoder(bpe.default_tokenizer())
ODD = ["", " ", "it's they're", "ÀÉ é İ ΑΣ ς", "a\x1cb\x85c d e　f\x0bg\x1f", "<|endoftext|>x <|startoftext|>", "''''s 're", "漢字かな" * 40, "“Été” l’été n’ª 3²¼ µßÿ— x", "😀👍🏽" * 9, "﻿x​y", "1234 ½ ２"]


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def want(text):
    return CODER.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.sampled_from(ODD), st.text(alphabet="aé'sT re\n0漢́<|>", max_size=60)))
def test_words_equal_the_whole_text(text):
    assert ids(CODER.batch([text])[0]) == want(text)


def test_latin_words_need_only_the_model(monkeypatch):
    text = "Plain words, it's é-ß\x00\x7f 3²¼ µª x\xady <|>"
    coder = bpe.Encoder(bpe.default_tokenizer())
    monkeypatch.setattr(coder, "tokenizer", None)  # the way through normalizer and splitter takes most of the time
    assert ids(coder.batch([text])[0]) == want(text)


def test_long_words_are_not_held(monkeypatch):
    monkeypatch.setattr(bpe, "HELD_CHARS", 1000)
    coder = bpe.Encoder(bpe.default_tokenizer())
    texts = ["漢字" * 300, "a short word " * 3, "ab" * 400]
    assert [ids(x) for x in coder.batch(texts)] == [want(t) for t in texts]
    assert set(coder.known) == {"a", "short", "word"}
    assert [ids(x) for x in coder.batch(texts)] == [want(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab cés'0漢!́\n"), st.characters(codec="utf-8")), min_size=1, max_size=400), st.integers(3, 60), st.integers(1, 16))
def test_tree_equals_the_whole_text(text, most, half):
    bounds = bpe.leaf_bounds(len(text), most)
    leaves = [bpe.segment(CODER, text[a:b], a) for a, b in bounds]
    old, bpe.join.__defaults__ = bpe.join.__defaults__, (half,)
    try:
        assert bpe.tree(CODER, leaves, lambda a, b: text[a:b]) == want(text)
    finally:
        bpe.join.__defaults__ = old


def test_leaves_cover_the_text():
    for n in (1, 7, 100, 1001):
        bounds = bpe.leaf_bounds(n, 10)
        assert bounds[0][0] == 0 and bounds[-1][1] == n and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:])) and max(b - a for a, b in bounds) <= 10


def test_spark_round_trip(spark):
    texts = [None, *ODD, "unsplit" * 3000, "words and more " * 900, "漢字かな" * 2000, "same", "same"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, long_chars=4000)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert ids(got[i].ids) == want(t or "")
        assert got[i].decoded == CODER.tokenizer.decode(want(t or ""), skip_special_tokens=False)
    assert bpe.encode(docs.limit(0)).count() == 0


def test_shuffled_input(spark, tmp_path):
    """Long texts keep their doc_id when a shuffle, a random sort or a join comes before; rows that are equal each give a row."""
    texts = [f"text {i} " + f"w{i}x " * (200 + 7 * i) for i in range(40)]
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[5]), (None, texts[6])], "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    keys = docs.select(F.col("doc_id").alias("k")).distinct()
    shuffled = [docs, docs.repartition(3), docs.orderBy(F.rand()), docs.join(keys, F.expr("doc_id <=> k")).drop("k")]
    expected = sorted([(str(i), want(t)) for i, t in enumerate(texts)] + [("3", want(texts[3])), ("None", want(texts[5])), ("None", want(texts[6]))])
    for rows in shuffled:
        assert sorted((str(r.doc_id), ids(r.ids)) for r in bpe.encode(rows, long_chars=300).collect()) == expected
    assert sorted((str(r.doc_id), ids(r.ids)) for r in bpe.round_trip(shuffled[1], long_chars=300).select("doc_id", "ids").collect()) == expected


def test_query_on_the_small_tables(spark):
    rows = {r.doc_id: r for r in op9_bpe_round_trip(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        x = want(r.text or "")
        assert rows[r.doc_id].n_tokens == len(x) and rows[r.doc_id].ids_sha256 == hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()
        assert rows[r.doc_id].decoded_sha256 == hashlib.sha256(CODER.tokenizer.decode(x, skip_special_tokens=False).encode()).hexdigest()
