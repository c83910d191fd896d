"""BPE encoding and decoding with a given tokenizer file.

Where the tokenizer file splits each word by itself with a pattern (``splitter``), the ids of a text are those of its words, and each worker
keeps the ids of the words it has met; Latin-1 words are split here and their pieces given to the file's model. With any other file texts are
encoded whole. Decoding is the tokenizer's own. A text above LONG_CHARS is cut into leaves that Spark deals out as rows and encodes in
parallel; a tree of joins then puts the halves together. A join re-encodes a window around the cut, and lets it grow until its tokens agree
with those of both halves: the halves' tokens outside of the agreement and the window's tokens inside are the encoding of the whole.

Null counts as empty text and gives no ids. Equal rows, and rows with a null or repeated doc_id, get results by their texts; an empty table
gives an empty result. Other columns of the input are not read. A text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longer texts are cut into leaves of at most half as many code points.
LONG_CHARS = 65_536
#: From so many words on, or so many code points of new ones, a worker forgets the words that it met once, and those that are longer than this.
CACHED_WORDS = 350_000
HELD_CHARS = 8_000_000
CACHED_CHARS = 48
#: Code points that are encoded together; bounds the words held at once.
BATCH_CHARS = 1_000_000
#: Half of the first window around a join, and the tokens in a row that must agree on each side.
WINDOW = 64
AGREE = 3
#: str.split() takes these as white space, the tokenizer does not.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def splitter(tokenizer) -> re.Pattern | None:
    """The pattern by which a tokenizer splits lower-cased Latin-1 text, if it normalizes and splits each word by itself."""
    state = lambda part: json.loads(part.__getstate__()) if part else {}
    first, *rest = state(tokenizer.pre_tokenizer).get("pretokenizers") or [{}]
    cuts = (first.get("type"), first.get("behavior"), first.get("invert")) == ("Split", "Removed", True)
    bytes_only = [(x.get("type"), x.get("use_regex"), x.get("add_prefix_space")) for x in rest] == [("ByteLevel", False, False)]
    if not (cuts and bytes_only) or state(tokenizer.normalizer).get("normalizers") != _NORMALIZERS or tokenizer.post_processor or type(tokenizer.model).__name__ != "BPE":
        return None
    pattern = first["pattern"]["Regex"]
    for kind in "LN":
        members = (chr(c) for c in range(256) if unicodedata.category(chr(c))[0] == kind)
        pattern = pattern.replace(f"\\p{{{kind}}}", "".join(map(re.escape, members)))
    made = re.compile(pattern)
    return None if any(x != x.strip() for x in made.findall(" a  1 . ' \t's ")) else made


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Numbered(dict):
    """Words and their numbers; a new one gets the next."""

    def __init__(self, words: list[str] = ()):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """A tokenizer with the ids of the words met so far."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pattern, self.model = splitter(self.tokenizer), self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]

    def clear(self) -> None:
        """Forgets all words."""
        self.known, self.held, self.pool = _Numbered(), 0, np.zeros(0, "<u4")
        self.starts, self.counts, self.seen = (np.zeros(0, np.int64) for _ in range(3))  # of each word: place and length in the pool, how often met

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def words(self, text: str) -> list[str] | None:
        """What the tokenizer encodes one by one; None if only the tokenizer knows."""
        if self.pattern is None or any(c in text for c in _NOT_SPACE) or any(t in text for t in self.added):
            return None
        return (text.lower() if _latin(text) else text).split()

    def _latin_ids(self, word: str) -> list[int]:
        """Ids of a Latin-1 word, which is its own normal form: the model gets its pieces with characters for their bytes."""
        return [t.id for piece in self.pattern.findall(word.lower()) for t in self.model.tokenize(piece if piece.isascii() and piece.isprintable() else piece.translate(_byte_characters()))]

    def learn(self, words: list[str]) -> None:
        """Appends the ids of distinct words to the pool; encodes those beyond Latin-1 in one call."""
        ids = [self._latin_ids(w) if _latin(w) else None for w in words]
        beyond = [k for k, made in enumerate(ids) if made is None]
        if beyond:
            made = self.tokenizer.encode([words[k] for k in beyond], is_pretokenized=True, add_special_tokens=False)
            ends = np.cumsum(np.bincount(np.array(made.word_ids, np.int64), minlength=len(beyond)))
            for k, part in zip(beyond, np.split(np.array(made.ids, "<u4"), ends[:-1]), strict=True):
                ids[k] = part.tolist()
        counts = np.array([len(made) for made in ids], np.int64)
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.seen = np.concatenate([self.seen, np.zeros(len(words), np.int64)])
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), "<u4")])
        self.held += sum(map(len, words))

    def forget(self) -> None:
        """Keeps the words that were met more than once."""
        kept = self.seen > 1
        words = [w for w, k in zip(self.known, kept.tolist(), strict=True) if k and len(w) <= CACHED_CHARS]
        old = np.array([self.known[w] for w in words], np.int64)
        flat = self._ids_of(old)
        self.known, self.held = _Numbered(words), 0
        self.pool, self.counts, self.seen = flat, self.counts[old], self.seen[old] // 2
        self.starts = np.cumsum(self.counts) - self.counts

    def _ids_of(self, numbers: np.ndarray) -> np.ndarray:
        counts = self.counts[numbers]
        ends = np.cumsum(counts)
        return self.pool[np.repeat(self.starts[numbers] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.words(text) for text in texts]
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(filter(None, cut))), np.int64)
        if self.known.new:
            self.learn(self.known.new)
            self.known.new = []
        self.seen += np.bincount(numbers, minlength=len(self.seen))
        raw = memoryview(self._ids_of(numbers).tobytes())
        ends = np.concatenate([[0], np.cumsum(self.counts[numbers])])[np.cumsum([0, *[len(x or ()) for x in cut]])] * 4
        made = [self.whole(t) if x is None else bytes(raw[a:b]) for t, x, a, b in zip(texts, cut, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        if len(self.known) > CACHED_WORDS or self.held > HELD_CHARS:
            self.forget()
        return made

    def decode(self, ids: bytes) -> str:
        """The tokenizer's own decoding; without a decoder in the file that is the tokens with spaces between them."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        return " ".join(map(self.tokens.__getitem__, numbers)) if self.tokenizer.decoder is None else self.tokenizer.decode(numbers, skip_special_tokens=False)


@lru_cache(maxsize=1)
def _byte_characters() -> dict[int, str]:
    """What byte-level splitting makes of each Latin-1 character."""
    from tokenizers.pre_tokenizers import ByteLevel

    level = ByteLevel(add_prefix_space=False, use_regex=False)
    return {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(256)}


def _latin(text: str) -> bool:
    """Whether all characters are Latin-1: these are their own normal form, and their lower case doesn't depend on their neighbours."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def in_groups(texts: list[str | None]) -> Iterator[list[str]]:
    """Runs of texts with BATCH_CHARS code points at most, or one text."""
    group, size = [], 0
    for text in texts:
        text = text or ""
        if group and size + len(text) > BATCH_CHARS:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


# Tree concatenation

Segment = tuple[int, int, np.ndarray]  # start, end, tokens as rows of start, end, id


def leaf_bounds(n: int, most: int) -> list[tuple[int, int]]:
    """Halves of halves, down to leaves of at most ``most``."""
    if n <= most:
        return [(0, n)]
    left = leaf_bounds(n // 2, most)
    return left + [(a + n // 2, b + n // 2) for a, b in leaf_bounds(n - n // 2, most)]


def segment(coder: Encoder, text: str, start: int) -> Segment:
    made = coder.tokenizer.encode(text, add_special_tokens=False)
    spans = np.array(made.offsets, np.int64).reshape(-1, 2) + start
    return start, start + len(text), np.column_stack([spans, np.array(made.ids, np.int64)])


def _agreement(tokens: list, window: list, forward: bool) -> tuple[int, int] | None:
    """Indices in tokens and window from which AGREE tokens in a row are equal: the first ones, or the last ones."""
    place = {t: i for i, t in enumerate(tokens)}
    order = range(1, len(window) - AGREE) if forward else range(len(window) - AGREE - 1, 0, -1)
    for j in order:
        if window[j][0] == window[j - 1][0]:
            continue  # bytes of one character
        i = place.get(window[j])
        if i is not None and i + AGREE < len(tokens) + (not forward) and (forward or i > 0) and tokens[i : i + AGREE] == window[j : j + AGREE]:
            return i, j
    return None


def join(coder: Encoder, left: Segment, right: Segment, text_of: Callable[[int, int], str], half: int = WINDOW) -> Segment:
    """The encoding of two neighbouring stretches of a text from those of each. Only tokens around the cut are looked at."""
    cut, tuples = right[0], lambda rows: list(map(tuple, rows.tolist()))
    while True:
        a, b = max(left[0], cut - half), min(right[1], cut + half)
        made = segment(coder, text_of(a, b), a)[2]
        window = tuples(made)
        whole_left, whole_right = a == left[0], b == right[1]
        first = len(left[2]) if whole_left else int(np.searchsorted(left[2][:, 0], a))
        last = 0 if whole_right else int(np.searchsorted(right[2][:, 1], b, side="right"))
        from_left = (0, 0) if whole_left else _agreement(tuples(left[2][first:]), window, True)
        from_right = (0, len(window)) if whole_right else _agreement(tuples(right[2][:last]), window, False)
        if from_left and from_right and from_left[1] + AGREE * (not whole_left) <= from_right[1] + AGREE * (not whole_right):
            kept = left[2][:0] if whole_left else left[2][: first + from_left[0]]
            rest = right[2][:0] if whole_right else right[2][from_right[0] :]
            if not len(kept) or not len(rest) or from_left[1] <= from_right[1]:
                return left[0], right[1], np.concatenate([kept, made[from_left[1] : from_right[1]], rest])
        if whole_left and whole_right:
            return left[0], right[1], made
        half *= 2


def tree(coder: Encoder, leaves: list[Segment], text_of: Callable[[int, int], str]) -> list[int]:
    """Joins neighbours, level by level."""
    while len(leaves) > 1:
        leaves = [join(coder, *leaves[k : k + 2], text_of) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
    return leaves[0][2][:, 2].tolist()


# Spark

_LEAF = "doc_id {kind}, digest binary, leaf int, start long, text string"
_ENCODED_LEAF = f"{_LEAF}, tokens binary"


def _cut(most: int) -> Callable:
    """Leaves of each text. A text's name is its digest: unlike a row number it is the same whenever the rows are computed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for row, text in enumerate(batch.column("text")):
                text = text.as_py()
                digest, bounds = hashlib.sha256(text.encode()).digest(), leaf_bounds(len(text), most)
                columns = [doc_ids.take(pa.array([row] * len(bounds), pa.int64())), pa.array([digest] * len(bounds), pa.binary()), pa.array(range(len(bounds)), pa.int32()), pa.array([a for a, _ in bounds], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([text[a:b] for a, b in bounds], pa.string())], names=["doc_id", "digest", "leaf", "start", "text"])

    return run


def _encode_leaves(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [segment(encoder(path), t, a)[2].astype("<i8").tobytes() for t, a in zip(batch.column("text").to_pylist(), batch.column("start").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, "tokens"])

    return run


def _join_leaves(path: str, decoded: bool) -> Callable:
    def run(leaves: pa.Table) -> pa.Table:
        copies = pc.sum(pc.equal(leaves.column("leaf"), 0)).as_py()  # rows that are equal in doc_id and text
        doc_ids, parts = leaves.column("doc_id").slice(0, 1), leaves.select(["leaf", "start", "text", "tokens"]).sort_by("leaf").to_pylist()[::copies]
        text = "".join(p["text"] for p in parts)
        segments = [(p["start"], p["start"] + len(p["text"]), np.frombuffer(p["tokens"], "<i8").reshape(-1, 3)) for p in parts]
        raw = np.array(tree(encoder(path), segments, lambda a, b: text[a:b]), "<u4").tobytes()
        columns = {"doc_id": doc_ids.take(pa.array([0] * copies)), "ids": pa.array([raw] * copies, pa.binary())}
        return pa.table(columns | {"decoded": pa.array([encoder(path).decode(raw)] * copies, pa.string())} if decoded else columns)

    return run


def _encode_rows(path: str, decoded: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            at, doc_ids = 0, batch.column("doc_id")
            for group in in_groups(batch.column("text").to_pylist()):
                ids = coder.batch(group)
                columns = [doc_ids.slice(at, len(group)), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([coder.decode(x) for x in ids], pa.string()))
                at += len(group)
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    return run


def encode_long(rows: DataFrame, path: str, most: int = LONG_CHARS, decoded: bool = False) -> DataFrame:
    """doc_id and ids of rows (doc_id, text) by tree concatenation, and decoded if that is asked for. doc_id goes with the leaves."""
    kind = dict(rows.dtypes)["doc_id"]
    leaves = rows.mapInArrow(_cut(max(most // 2, 1)), _LEAF.format(kind=kind)).repartition("digest", "leaf").mapInArrow(_encode_leaves(path), _ENCODED_LEAF.format(kind=kind))
    return leaves.groupBy("doc_id", "digest").applyInArrow(_join_leaves(path, decoded), f"doc_id {kind}, ids binary" + ", decoded string" * decoded)


def _encoded(docs: DataFrame, path: str, doc_id: str, text: str, long_chars: int, decoded: bool) -> DataFrame:
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    is_long = F.char_length("text") > long_chars
    short = rows.where(~is_long).mapInArrow(_encode_rows(path, decoded), f"doc_id {dict(rows.dtypes)['doc_id']}, ids binary" + ", decoded string" * decoded)
    return short.unionByName(encode_long(rows.where(is_long), path, long_chars, decoded))


def encode(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", long_chars: int = LONG_CHARS) -> DataFrame:
    """doc_id and ids of every row: little-endian unsigned 32-bit integers without special tokens of the tokenizer's own."""
    return _encoded(docs, tokenizer or default_tokenizer(), doc_id, text, long_chars, False)


def round_trip(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", long_chars: int = LONG_CHARS) -> DataFrame:
    """doc_id, ids and decoded of every row, in one pass."""
    return _encoded(docs, tokenizer or default_tokenizer(), doc_id, text, long_chars, True)


def _decode_rows(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            step = max(1, BATCH_CHARS * len(batch) // max(1, batch.nbytes))
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                texts = [coder.decode(x.as_py() or b"") for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return run


def decode(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """rows, which have a column ids, with the decoded text."""
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(_decode_rows(tokenizer or default_tokenizer()), f"{schema}, decoded string")
