"""Quality rules with host verdicts.

Every document is measured by itself (word, symbol, line and repeat counts) and tested against a set of rules.
Rule failures are summed by host, the failure rates are shrunk with a beta prior fitted to all hosts, and a host whose
shrunken rate exceeds the limit has that rule enforced: its documents that fail the rule are rejected. A document that
passes all rules is kept on any host; the two base rules reject on any host.

Null text counts as empty text (0 words, so the base rule fails); documents with a null host get no host verdict. Equal rows get equal results,
whatever their doc_id; a text of any length is measured whole; an empty table gives an empty result, and further columns of the input, of any
name, pass through ``filter_documents`` untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, written

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
#: Rules that count only where a host fails them as a habit.
HOST_RULES = {
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 3 * n_words or word_chars > 10 * n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "few_words": f"n_words < {MIN_WORDS}",
    "repeated_words": f"100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words",
}
BASE_FAILED = f"{HOST_RULES['few_words']} or {HOST_RULES['repeated_words']}"
HOST_LIMIT = 0.5
#: More flagged hosts than this are joined by a shuffle instead of a broadcast.
BROADCAST_HOSTS = 100_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
_DROP_SPACES = dict.fromkeys(SPACES)
_STEPS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(WINDOW)], dtype=np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of 8 words which occurs twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, n)
    if len(ids) == n:
        return 0
    mixed = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    m = n - WINDOW + 1
    rolled = np.zeros(m, dtype=np.uint64)
    for k in range(WINDOW):
        rolled += mixed[k : k + m] * _STEPS[k]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    starts = np.zeros(m, dtype=bool)
    a, b = order[:-1][same], order[1:][same]
    equal = np.ones(len(a), dtype=bool)
    for k in range(WINDOW):  # equal sums are compared word by word
        equal &= codes[a + k] == codes[b + k]
    starts[a[equal]] = starts[b[equal]] = True
    edges = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def duplicate_lines(raw: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def measure(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    symbols = sum(map(text.count, "#*$%&|<>"))
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    return len(words), len(text) - spaces, symbols, *duplicate_lines(raw), repeated_words(words)


@F.pandas_udf(_SCHEMA)
def _measures(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(x) for x in text], columns=COUNTS, dtype="int64")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column _measures of COUNTS."""
    return docs.withColumn("_measures", _measures.asNondeterministic()(F.col(text)))


def host_rates(rows: DataFrame, host: str = "host") -> DataFrame:
    """Per host: documents, and for each rule the failure rate shrunk by a beta prior fitted to all hosts."""
    sums = [F.sum(F.expr(rule).cast("long")).alias(f"k_{name}") for name, rule in HOST_RULES.items()]
    hosts = written(rows.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n"), *sums))
    n = F.col("n")
    stats = [F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum(n.cast("double") * n).alias("nn")]
    for name in HOST_RULES:
        k = F.col(f"k_{name}")
        stats += [F.sum(k).alias(f"k_{name}"), F.sum(k.cast("double") * k / n).alias(f"kk_{name}")]
    found = hosts.agg(*stats).first()  # thirteen numbers
    shrunk = []
    for name in HOST_RULES:
        a, b = beta_prior(found.hosts, found.n or 0, found.nn or 0.0, found[f"k_{name}"] or 0, found[f"kk_{name}"] or 0.0)
        shrunk.append(((F.col(f"k_{name}") + a) / (F.col("n") + a + b)).alias(f"rate_{name}"))
    return hosts.select(host, "n", *shrunk)


def beta_prior(hosts: int, n: int, nn: float, k: int, kk: float) -> tuple[float, float]:
    """Beta parameters of a beta-binomial fitted by moments, hosts weighted by their documents.

    n, nn, k and kk are the sums over the hosts of their documents, the squares of these, the failures, and failures ** 2 / documents. The
    spread of the rates that binomial sampling makes by itself is taken off. The prior weighs 1 to 1000 documents: 1000 where no spread is left.
    """
    m = min(max(k / n if n else 0.5, 1e-3), 1 - 1e-3)
    if not n:
        return m * 1000.0, (1 - m) * 1000.0
    spread, free = (kk - k * k / n) / (m * (1 - m)) - (hosts - 1), n - nn / n - (hosts - 1)
    alike = spread / free if free > 0 else 0.0  # correlation of two documents of a host
    weight = min(max(1 / alike - 1, 1.0), 1000.0) if alike > 0 else 1000.0
    return m * weight, (1 - m) * weight


def _enforced() -> Column:
    """The rules that a host's verdict enforces."""
    return F.filter(F.array(*[F.when(F.col(f"rate_{n}") > HOST_LIMIT, F.lit(n)) for n in HOST_RULES]), lambda x: x.isNotNull())


def host_verdicts(rows: DataFrame, host: str = "host") -> DataFrame:
    """Hosts with at least one enforced rule."""
    return host_rates(rows, host).select(host, _enforced().alias("enforced")).where(F.size("enforced") > 0)


def _failed() -> Column:
    return F.filter(F.array(*[F.when(F.expr(rule), F.lit(n)) for n, rule in HOST_RULES.items()]), lambda x: x.isNotNull())


def _with_verdicts(rows: DataFrame, verdicts: DataFrame, host: str) -> DataFrame:
    verdicts = written(verdicts)
    if verdicts.count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    joined = rows.join(verdicts, host, "left")
    by_host = F.coalesce(F.arrays_overlap(_failed(), "enforced"), F.lit(False))
    base = F.expr(BASE_FAILED)
    return joined.select(*rows.columns, base.alias("base_failed"), (~base & ~by_host).alias("kept"))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host, the counts of every document, base_failed and kept."""
    rows = measured(docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text")))
    rows = written(rows.select("doc_id", "host", "_measures.*"))
    return _with_verdicts(rows, host_verdicts(rows), "host")


def filter_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The rows of docs that are kept, with the columns of docs."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(whole, F.col(host).alias("_host"), F.col(text).alias("_text"))
    rows = written(rows.withColumn("_measures", _measures.asNondeterministic()("_text")).select("_row", "_host", "_measures.*"))
    kept = _with_verdicts(rows, host_verdicts(rows.select("_host", *COUNTS), "_host"), "_host")
    return kept.where("kept").select("_row.*")
