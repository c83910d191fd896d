import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from devicelogs.llm import language_id as g
from devicelogs.llm.query_12 import op12_language_id

SF = "/root/testdata/sf0.01"


def count(texts, order):
    """Contexts by language, counted letter by letter."""
    found = Counter()
    for language, text in texts:
        for word in text.encode().split():
            line = b" " + word.decode().lower().encode() + b" "
            for k in range(1, len(line)):
                for m in range(min(order, k) + 1):
                    found[language, line[k - m : k], line[k]] += 1
    return {k: n for k, n in found.items() if n > 1 or k[1] == b""}


def probability(counts, context, byte, excluded=frozenset()):
    """Exact probability of a byte by the recursive definition."""
    seen = {b: n for (c, b), n in counts.items() if c == context and b not in excluded}
    shorter = lambda x: probability(counts, context[1:], byte, x) if context else Fraction(1, 256 - len(x))
    if not seen:
        return shorter(excluded)
    size, distinct = sum(seen.values()), len(seen)
    if byte in seen:
        return Fraction(seen[byte], size + distinct)
    return Fraction(distinct, size + distinct) * shorter(excluded | set(seen))


def brute_cost(counts, word, order):
    line = b" " + word + b" "
    return sum(-math.log2(probability(counts, line[max(0, k - order) : k], line[k])) for k in range(1, len(line)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abé ", min_size=1, max_size=12), min_size=1, max_size=5), st.text(alphabet="abcé", max_size=6), st.integers(0, 4))
def test_costs_equal_the_definition(texts, word, order):
    rows = count([("x", t) for t in texts], order)
    model = g.Model([(*k, n) for k, n in rows.items()], order)
    counts = {(c, b): n for (_, c, b), n in rows.items()}
    if model.counts:
        line = b" " + word.encode() + b" "
        got = sum(g.cost(model.counts[0], line[max(0, k - order) : k], line[k]) for k in range(1, len(line)))
        assert abs(got / g.UNIT - brute_cost(counts, word.encode(), order)) < 1e-3
        if word:
            scorer = g.Scorer(model)
            scorer.keys[:] = 1  # every place is taken
            assert g.Scorer(model).totals(["", word, f" {word}\t\n{word}"])[:, 0].tolist() == scorer.totals(["", word, f" {word}\t\n{word}"])[:, 0].tolist() == [0, got, 2 * got]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abÉ \x00\n\x1c", max_size=8), min_size=1, max_size=4), st.integers(0, 6))
def test_windows(texts, order):
    found, sizes = g.windows(texts, order)
    want, at = [], 0
    for text, n in zip(texts, sizes.tolist()):
        steps = []
        for word in text.lower().encode().split():
            line = b" " + word + b" "
            steps += [(line[max(0, k - order) : k], line[k]) for k in range(1, len(line))]
        assert [g.unpacked(x) for x in found[at : at + n].tolist()] == steps
        at += n
    assert at == len(found)


def test_probabilities_sum_to_one():
    rows = count([("x", "banana bandana ananas nab")], 3)
    counts = {(c, b): n for (_, c, b), n in rows.items()}
    for context in (b"", b"a", b" ba", b"ana", b"zz"):
        assert sum(probability(counts, context, b) for b in range(256)) == 1


def test_spark_counts_and_prediction(spark):
    texts = [(k, ["en", "fr"][k % 2], ["The cat sat on the mat", "Le chat est sur la natte à côté"][k % 2] + f" {k}") for k in range(60)]
    odd = [(100, None, "the cat"), (None, "xx", "zzz zzz"), (101, "en", None), (102, "fr", ""), (103, "en", "123 -- 45"), (104, None, "LE CHAT"), (105, None, "le chat " * 3000 + "q" * 5000)]
    docs = spark.createDataFrame([(d, t, x, "s", 1.0) for d, x, t in texts + odd], "doc_id long, text string, lang string, source string, score double")
    model = g.train(docs, order=3)
    learnt = [(x, t) for d, x, t in texts + odd if x and d is not None and t is not None and zlib.crc32(str(d).encode()) % 4 != 2]
    want = count(learnt, 3)
    assert {(x, c, b): n for x, counts in zip(model.languages, model.counts) for c, after in counts.items() for b, n in after.items()} == want
    for rows in (docs, docs.repartition(3)):
        found = {r.doc_id: r for r in g.identify(rows, model).collect()}
        assert len(found) == len(texts) + len(odd)
        assert all(found[d].lang_pred == x for d, x, _ in texts) and found[104].lang_pred == found[105].lang_pred == "fr" and found[100].lang_pred == "en"
        assert all(found[d].lang_pred == "und" and found[d].score == 0 for d in (101, 102, 103))
        assert all(0 <= r.score <= 1 for r in found.values())
        assert all(r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2) for d, r in found.items())
    counts = defaultdict(dict)
    for (x, c, b), n in want.items():
        counts[x][c, b] = n
    bits = {x: sum(brute_cost(counts[x], w.lower().encode(), 3) for w in "The cat est".split()) for x in ("en", "fr")}
    got = g.Scorer(model).predict(["The cat est"])[0]
    assert got[0] == min(bits, key=bits.get) and abs(got[1] - 1 / sum(2 ** (min(bits.values()) - b) for b in bits.values())) < 1e-3
    empty = g.identify(docs.limit(0), model)
    assert empty.count() == 0 and empty.columns == ["doc_id", "held_out", "lang_pred", "score"]
    nothing = g.train(docs.where("lang = 'none'"))
    assert {r.lang_pred for r in g.identify(docs, nothing).collect()} == {"und"}


def test_sample_is_bounded_by_language(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "if(id % 10 = 0, 'b', 'a') as lang", "'t' as text")
    assert {r.lang: r["count"] for r in g.sample(docs, 25).groupBy("lang").count().collect()} == {"a": 25, "b": 25}
    same = docs.selectExpr("if(lang = 'a', 5, doc_id) as doc_id", "lang", "text")
    assert {r.lang: r["count"] for r in g.sample(same, 25).groupBy("lang").count().collect()} == {"b": 25}


def test_held_out_accuracy(spark):
    found = op12_language_id(spark, SF).where("held_out")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
