"""Toxicity by a weighted finite-state grammar.

Words are mapped to classes by a lexicon of weighted acceptors: insult stems (a prefix, then any ending) that are learnt from labelled
documents, and closed lists of threats with their endings, targets, negations and words of reported speech. A clause is read twice. From its
end, a transducer marks each word with whether a target comes after it. From its start, five transducers read the marked words: insult and
threat emit events, negation and reported speech keep a scope, target remembers whom the clause speaks of so far. They are composed into one
transducer whose output symbols are (event, negated, reported, targeted), targeted on either side. A document's features are the log of the
summed weights by symbol; a logistic model with a prior on these symbols gives the score, so a bare word counts by the clause around it.

Stems and weights are learnt from at most TRAIN_ROWS labelled rows; Spark sums the stems' counts and judges them, and all stems that pass are
the lexicon. Null text counts as empty, and a text of any length is read whole. Equal texts get equal scores, whatever the doc_id; further
columns pass through. Without labelled rows the score follows the prior weights alone; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .training import labelled_sample, logistic_fit, sigmoid

FOLDS, FOLD = 4, 2
TRAIN_ROWS = 40_000
THRESHOLD = 0.3
#: Lengths of stems; a whole shorter word can be learnt, too.
STEMS = range(4, 9)
#: A stem is learnt if it is in so many toxic documents, and the lower bound of its share of toxic documents is this high.
LEAST_DOCS, LEAST_SHARE, DEVIATIONS = 4, 0.5, 2.0
#: Words that a negation reaches.
NEGATION_SCOPE = 3
#: Words whose class a worker keeps, and stems that it counts before it passes their sums on.
_CACHED = 120_000
_COUNTED = 150_000

# Closed word lists. Threats are stems with the endings of their kind.
THREATS = {
    "kill hurt beat shoot stab+b punch burn+ destroy strangl~ choke~ slap+p bash smash attack threaten murder execut~": "english",
    "töt umbring vernicht erschieß erwürg": "german",
    "schlag": "german",
    "tu frapp étrangl massacr": "french",
    "détrui": "french_re",
    "mat golpe estrangul": "spanish_ar",
    "destru": "spanish_ir",
}
ENDINGS = {
    "german": "e st est t et en end te ten".split(),
    "french": "e es er ez ent é ée és ées ant ai erai eras era erons erez eront ais ait".split(),
    "french_re": "s t re sez sent rai ras ra ront sant t te".split(),
    "spanish_ar": "o as a amos an ar ando ado é aré ará arán aste aron aría arte arlo arla arlos".split(),
    "spanish_ir": "yo yes ye imos yen ir yendo ido iré irá irán irte irlo".split(),
}
TARGETS = "you your you're u they them their he him his she her us all everyone everybody du dich dir dein deine ihr euch ihn ihm vous tu toi te tú usted ustedes vosotros él ella ellos".split()
NEGATIONS = "not no never isn't aren't don't won't wouldn't nicht kein keine nie ne pas jamais nunca jamás".split()
REPORTS = "said says called claims according quoted wrote sagte sagt schrieb laut dit selon écrit dijo dice según".split()
INSULTS = "idiot moron stupid scum loser worthless pathetic disgusting trash clown".split()

NONE, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
CLASSES = range(7)
EVENTS = (INSULT, THREAT)
#: Output symbols: (event, negated, reported, targeted).
SYMBOLS = list(product(EVENTS, (0, 1), (0, 1), (0, 1)))
_CLAUSE_ENDS = frozenset(".!?;:,|")
_EDGES = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")


def threat_words() -> set[str]:
    """All forms of the threats. In English a stem that ends in ~ or e loses the e before endings, one with + doubles its last letter."""
    found = set()
    for stems, kind in THREATS.items():
        for stem in stems.split():
            if kind != "english":
                found.update(stem + e for e in ENDINGS[kind])
                continue
            base, _, double = stem.partition("+")
            base = base[:-1] + "e" * (base[-1] == "~" and base[-2] != "e") if base.endswith("~") else base
            bare = base.removesuffix("e")
            found.update({base, f"{base}s", f"{base}es" if base[-1] in "sh" else f"{base}s", f"{bare}{double}ed", f"{bare}{double}ing"})
    return found


class Transducer:
    """A Mealy machine over input symbols: arcs[state, symbol] = (next state, output)."""

    def __init__(self, arcs: dict[tuple[int, object], tuple[int, object]]):
        self.arcs = arcs
        self.inputs = list(dict.fromkeys(c for _, c in arcs))

    def __matmul__(self, other: Transducer) -> Transducer:
        """Both machines on the same input, with the pair of their outputs; only states that can be reached."""
        numbers, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        for a, b in todo:
            for c in self.inputs:
                (na, oa), (nb, ob) = self.arcs[a, c], other.arcs[b, c]
                if (na, nb) not in numbers:
                    numbers[na, nb] = len(numbers)
                    todo.append((na, nb))
                arcs[numbers[a, b], c] = (numbers[na, nb], (oa, ob))
        return Transducer(arcs)


#: Inputs of the grammar: a word class, and whether a target comes after it in the clause.
MARKED = list(product(CLASSES, (0, 1)))


def _machine(n: int, move: Callable[[int, int], int], out: Callable[[int, int, int], object]) -> Transducer:
    return Transducer({(s, (c, ahead)): (move(s, c), out(s, c, ahead)) for s in range(n) for c, ahead in MARKED})


def backwards() -> Transducer:
    """Reads a clause from its end and marks each class with whether a target was met before, which is after it in the text."""
    return Transducer({(s, c): (0 if c == END else int(s or c == TARGET), (c, s)) for s in (0, 1) for c in CLASSES})


def grammar() -> Transducer:
    """The composed transducer over marked classes; its output is ((((insult, threat), negated), reported), targeted)."""
    insult = _machine(1, lambda s, c: 0, lambda s, c, ahead: c == INSULT)
    threat = _machine(1, lambda s, c: 0, lambda s, c, ahead: c == THREAT)
    negation = _machine(NEGATION_SCOPE + 1, lambda s, c: 0 if c == END else NEGATION_SCOPE if c == NEGATION else max(s - 1, 0), lambda s, c, ahead: int(s > 0))
    reported = _machine(2, lambda s, c: 0 if c == END else 1 if c == REPORT else s, lambda s, c, ahead: s)
    target = _machine(2, lambda s, c: 0 if c == END else 1 if c == TARGET else s, lambda s, c, ahead: int(s or ahead))
    return insult @ threat @ negation @ reported @ target


def compiled() -> tuple[list[list[int]], list[list[int]]]:
    """The grammar as tables by state and 2 * class + mark: next state, and the number of the output symbol or -1."""
    arcs = grammar().arcs
    n = 1 + max(s for s, _ in arcs)
    place = {s: k for k, s in enumerate(SYMBOLS)}
    step, emit = [[0] * len(MARKED) for _ in range(n)], [[-1] * len(MARKED) for _ in range(n)]
    for (s, (c, ahead)), (to, ((((insult, threat), negated), reported), targeted)) in arcs.items():
        step[s][2 * c + ahead] = to
        if insult or threat:
            emit[s][2 * c + ahead] = place[INSULT if insult else THREAT, negated, reported, targeted]
    return step, emit


def mark(classes: list[int]) -> list[int]:
    """2 * class + mark of the classes of one line, in which END closes a clause."""
    arcs, state, out = _BACKWARDS, 0, []
    for c in reversed(classes):
        state, (kind, ahead) = arcs[state, c]
        out.append(2 * kind + ahead)
    return out[::-1]


_BACKWARDS = backwards().arcs


def core(word: str) -> str:
    """Lower case without what isn't a letter or digit at the ends."""
    return _EDGES.sub("", word.lower())


def stems(word: str) -> list[str]:
    """The prefixes that can be learnt, and the whole word with an end mark."""
    return [word[:k] for k in STEMS if k <= len(word)] + [word + "$"] * (len(word) > 2)


class Grammar:
    """Word classes of a lexicon and the clause features of texts; keeps the words it has met."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.closed = {w: c for c, words in ((THREAT, threat_words()), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
        self.step, self.emit = compiled()
        self.known: dict[str, tuple[int, float, bool]] = {}

    def _meet(self, word: str) -> tuple[int, float, bool]:
        inner = core(word)
        weight = max((self.lexicon.get(s, 0.0) for s in stems(inner)), default=0.0)
        kind = INSULT if weight > 0 else self.closed.get(inner, NONE)
        found = (kind, weight if weight > 0 else 1.0, word[-1] in _CLAUSE_ENDS)
        if len(self.known) >= _CACHED:
            self.known.clear()
        self.known[word] = found
        return found

    def features(self, text: str) -> np.ndarray:
        """log(1 + summed weights) by output symbol."""
        sums = np.zeros(len(SYMBOLS))
        get, meet = self.known.get, self._meet
        hits = {}
        for line in text.split("\n"):
            met = [get(w) or meet(w) for w in line.split()]
            if not any(m[0] in EVENTS for m in met):
                continue
            classes, weights = [], []
            for kind, weight, ends in met:
                classes += [kind, END] if ends else [kind]
                weights += [weight, 0.0] if ends else [weight]
            state = 0
            for c, weight in zip(mark(classes), weights, strict=True):
                symbol = self.emit[state][c]
                if symbol >= 0:
                    hits[symbol] = hits.get(symbol, 0.0) + weight
                state = self.step[state][c]
        for symbol, weight in hits.items():
            sums[symbol] = math.log1p(weight)
        return sums


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label by stem, summed in the task."""

    def out(counts: list[Counter]) -> pa.RecordBatch:
        names = [*counts[0], *(n for n in counts[1] if n not in counts[0])]
        arrays = [pa.array(names, pa.string()), *[pa.array([c[n] for n in names], pa.int64()) for c in (counts[1], counts[0])]]
        return pa.RecordBatch.from_arrays(arrays, names=["stem", "toxic", "clean"])

    counts = [Counter(), Counter()]
    for batch in batches:
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text"), strict=True):
            words = {core(w) for w in set((text.as_py() or "").split())}
            counts[int(label > 0)].update({s for w in words for s in stems(w)})
            if len(counts[0]) + len(counts[1]) > _COUNTED:
                made, counts = out(counts), [Counter(), Counter()]
                yield made
    yield out(counts)


def lower_bound(hits: int, n: int, z: float = DEVIATIONS) -> float:
    """Wilson's lower bound of a share."""
    if not n:
        return 0.0
    p = hits / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Stems and their weights (log odds): the surest first, then stems that the rest of their documents still bears out."""
    distinct = sample.groupBy("text").agg(F.max("label").alias("label")).select("label", "text")
    counts = distinct.mapInArrow(_counts, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    n, z = F.col("toxic") + F.col("clean"), DEVIATIONS
    p = F.col("toxic") / n
    bound = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)  # as lower_bound
    likely = counts.where((F.col("toxic") >= LEAST_DOCS) & (bound >= LEAST_SHARE - 1e-9))
    weights = {w + "$": 2.0 for w in INSULTS}
    found = {r.stem: (r.toxic, r.clean) for r in likely.collect()}  # stems of the sample's toxic documents
    odds = {stem: math.log((toxic + 0.5) / (clean + 0.5)) for stem, (toxic, clean) in found.items()}
    taken: dict[str, tuple[int, int]] = {}  # what longer stems have taken from a stem's documents
    learnt: set[str] = set()
    for stem in sorted(found, key=lambda x: (-odds[x], len(x), x)):
        if any(stem[:k] in learnt for k in STEMS if k < len(stem)):
            continue
        more = taken.get(stem, (0, 0))
        toxic, clean = (max(n - m, 0) for n, m in zip(found[stem], more, strict=True))
        if toxic < LEAST_DOCS or lower_bound(toxic, toxic + clean) < LEAST_SHARE:
            continue
        learnt.add(stem)
        weights[stem] = max(weights.get(stem, 0.0), math.log((toxic + 0.5) / (clean + 0.5)))
        for k in STEMS:
            if k < len(stem.rstrip("$")) + stem.endswith("$"):
                had = taken.get(stem[:k], (0, 0))
                taken[stem[:k]] = (had[0] + toxic, had[1] + clean)
    return weights


def _prior() -> tuple[np.ndarray, np.ndarray]:
    """Prior weights: an event counts, less so if negated or reported, more if it has a target; last the level."""
    prior = [1.0 + 0.5 * targeted - 0.7 * negated - 0.5 * reported for _, negated, reported, targeted in SYMBOLS]
    return np.array([*prior, -3.0]), np.array([0.2] * len(prior) + [0.01])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, fold: int = FOLD, rows: int = TRAIN_ROWS) -> tuple[dict[str, float], np.ndarray]:
    """The lexicon, and the weight of each output symbol with the level as the last."""
    sample = written(labelled_sample(docs, labels, label, folds, fold, rows).select("label", "text"))
    lexicon = learn_lexicon(sample)
    prior, strength = _prior()
    names = [f"f{k}" for k in range(len(SYMBOLS))]
    made = sample.mapInArrow(_features(sample, lexicon), ", ".join(["label int", *[f"{n} double" for n in names]]))
    points = made.groupBy(*names, "label").count().toPandas()  # equal rows once; no more than ``rows``
    if not len(points):
        return lexicon, prior
    x = np.column_stack([points[names].to_numpy(float), np.ones(len(points))])
    return lexicon, _weighted_fit(x, points.label.to_numpy(float), points["count"].to_numpy(int), prior, strength)


def _weighted_fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: np.ndarray, strength: np.ndarray) -> np.ndarray:
    return logistic_fit(np.repeat(x, n, axis=0), np.repeat(y, n), prior, strength)


def _features(like: DataFrame, lexicon: dict[str, float]) -> Callable:
    held = like.sparkSession.sparkContext.broadcast(lexicon)  # stems of TRAIN_ROWS documents at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Grammar(held.value)
        for batch in batches:
            rows = np.array([words.features(t.as_py() or "") for t in batch.column("text")]).reshape(len(batch), len(SYMBOLS))
            columns = [batch.column("label"), *[pa.array(rows[:, k]) for k in range(len(SYMBOLS))]]
            yield pa.RecordBatch.from_arrays(columns, names=["label", *[f"f{k}" for k in range(len(SYMBOLS))]])

    return run


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], column: str = "score", text: str = "text") -> DataFrame:
    """docs with one more column: the probability of label 1. docs must have no column of its name."""
    if column.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {column}; choose another name")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights = held.value
        words = Grammar(lexicon)
        for batch in batches:
            z = [words.features(t.as_py() or "") @ weights[:-1] + weights[-1] for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(np.array(z, float)))], names=[*batch.schema.names, column])

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(run, f"{schema}, `{column}` double")
