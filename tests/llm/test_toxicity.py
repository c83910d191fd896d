from itertools import product

import numpy as np
import pytest

from devicelogs.llm import toxicity as t
from devicelogs.llm.query_06 import op6_toxicity_grammar

SEEDS = {w + "$": 2.0 for w in t.INSULTS}


def symbols(text):
    g = t.Grammar(SEEDS)
    return {s for s, v in zip(t.SYMBOLS, g.features(text)) if v > 0}


def test_grammar_scores_clauses():
    assert symbols("nothing here") == set()
    assert symbols("IDIOT!!") == {(t.INSULT, 0, 0, 0)}
    assert symbols("you are an idiot") == {(t.INSULT, 0, 0, 1)}
    assert symbols("you are not an idiot") == {(t.INSULT, 1, 0, 1)}
    assert symbols("not now, idiot") == {(t.INSULT, 0, 0, 0)}
    assert symbols("not one two three four idiot") == {(t.INSULT, 0, 0, 0)}
    assert symbols("he said you stupid; I kill") == {(t.INSULT, 0, 1, 1), (t.THREAT, 0, 0, 0)}
    for text in ("I will kill you", "kill him", "killing you slowly", "someone kills you", "ich töte dich", "strangling them", "stabbed him", "ella te matará"):
        assert symbols(text) == {(t.THREAT, 0, 0, 1)}, text
    assert symbols("an idiot you are") == {(t.INSULT, 0, 0, 1)} and symbols("idiot, you are") == {(t.INSULT, 0, 0, 0)}


def slow_symbols(classes):
    """The grammar, word by word: what stands where in the clause."""
    out = set()
    for i, c in enumerate(classes):
        if c in t.EVENTS:
            start = max((k + 1 for k in range(i) if classes[k] == t.END), default=0)
            end = next((k for k in range(i, len(classes)) if classes[k] == t.END), len(classes))
            out.add((i, (c, int(t.NEGATION in classes[max(start, i - 3) : i]), int(t.REPORT in classes[start:i]), int(t.TARGET in classes[start:end]))))
    return out


def test_grammar_against_brute_force():
    step, emit = t.compiled()
    rng = np.random.default_rng(0)
    cases = [list(x) for n in range(1, 5) for x in product(range(7), repeat=n)] + [rng.integers(0, 7, 12).tolist() for _ in range(3000)]
    for classes in cases:
        state, got = 0, set()
        for i, c in enumerate(t.mark(classes)):
            if emit[state][c] >= 0:
                got.add((i, t.SYMBOLS[emit[state][c]]))
            state = step[state][c]
        assert got == slow_symbols(classes)


def test_composition_is_the_product():
    step, emit = t.compiled()
    assert len(step) == (t.NEGATION_SCOPE + 1) * 4 and {e for row in emit for e in row} == {-1, *range(len(t.SYMBOLS))}


def test_lower_bound():
    assert t.lower_bound(0, 0) == 0 and t.lower_bound(5, 5) < t.lower_bound(50, 50) < 1


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op6_toxicity_grammar(spark, "/root/testdata/sf0.1").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [d for d in labels if got[d].held_out]
    hits = [got[d].predicted for d in held if labels[d]]
    clean = [got[d].predicted for d in held if not labels[d]]
    assert len(got) == 10_000 and np.mean(hits) > 0.9 and np.mean(clean) < 0.02


def test_odd_rows(spark):
    rows = [(None, None, "x"), (1, "", "x"), (2, "you idiot", "x"), (2, "you idiot", "x"), (3, "long " * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    got = {(r.doc_id, r.score) for r in t.score(docs, t.train(docs, labels)).collect()}
    scores = dict(got)
    assert len(got) == 4 and scores[2] > 0.3 > scores[3]
    none = t.score(docs, t.train(docs, labels.limit(0))).collect()
    assert len(none) == 5 and max(none, key=lambda r: r.score).doc_id == 2
    assert t.score(docs.limit(0), t.train(docs.limit(0), labels)).count() == 0
    with pytest.raises(ValueError):
        t.score(docs.withColumnRenamed("label", "Score"), t.train(docs, labels))
    clash = docs.withColumnRenamed("label", "_score")
    assert t.score(clash, t.train(docs, labels)).columns == ["doc_id", "text", "_score", "score"]


def test_several_texts_of_one_id_are_learnt_alike(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    rows = [(1, "you idiot"), (1, "fine words"), (2, "so it is"), (2, None)]
    models = [t.train(spark.createDataFrame(x, "doc_id long, text string"), labels) for x in (rows, rows[::-1])]
    assert models[0][0] == models[1][0] and (models[0][1] == models[1][1]).all()
