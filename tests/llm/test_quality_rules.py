import re
from collections import Counter

import numpy as np

from devicelogs.llm import quality_rules as q

DOCS = "doc_id long, text string, source string, kept string, n_words int"


def brute_repeats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    return len(inside)


def test_measures_match_brute_force():
    texts = ["", " \n\t", "a " * 30, "x y z " * 20 + "é# ü|", "one\n\none\n two \none", "w" * 5000, " ".join(f"w{i % 11}" for i in range(100)), "a b c d"]
    for t in texts:
        n_words, chars, symbols, n_lines, dup, rep = q.measure(t)
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (n_words, chars, symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (n_lines, dup, rep) == (len(lines), len(lines) - len(set(lines)), brute_repeats(t))
    assert q.measure(None) == (0, 0, 0, 0, 0, 0)


def test_host_verdicts(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    noisy = " ".join(f"wo#d{i}" for i in range(40))
    rows = [(i, noisy, "bad", "x", 1) for i in range(50)] + [(50, clean, "bad", "x", 1), (51, noisy, "good", "x", 1)]
    rows += [(52 + i, clean, "good", "x", 1) for i in range(50)] + [(200, None, None, None, None), (200, None, None, None, None), (None, clean, None, "x", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, r.kept) for r in q.quality_rules(docs).collect()}
    assert (0, False) in got and (50, True) in got and (51, True) in got and (200, False) in got and (None, True) in got
    kept = q.filter_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == 53
    assert q.quality_rules(docs.limit(0)).count() == 0


def sums(ns, ks):
    return len(ns), sum(ns), float(sum(n * n for n in ns)), sum(ks), sum(k * k / n for n, k in zip(ns, ks))


def test_beta_prior():
    assert q.beta_prior(0, 0, 0.0, 0, 0.0) == (500.0, 500.0)
    rng = np.random.default_rng(1)
    ns = rng.integers(1, 60, 20_000).tolist()
    for a, b in ((2.0, 6.0), (0.8, 4.0), (20.0, 20.0)):  # hosts of few documents give the prior that they were drawn from
        ks = rng.binomial(ns, rng.beta(a, b, len(ns))).tolist()
        got = q.beta_prior(*sums(ns, ks))
        assert abs(got[0] / sum(got) - a / (a + b)) < 0.01 and abs(sum(got) - a - b) < 0.08 * (a + b)
    ks = rng.binomial(ns, 0.3).tolist()  # no spread but that of sampling
    assert sum(q.beta_prior(*sums(ns, ks))) > 200
    assert sum(q.beta_prior(*sums([50, 50], [0, 50]))) == 1.0
