"""Jaccard self-join of documents on word shingles by a grouped prefix join, and its connected components.

1. Shingle sets are hashed per document. Blocks of documents send their shingles, packed as arrays, to hash buckets, which count in how many
   sets each occurs, and get back the shingles that occur in two sets or more. A shingle that is frequent within a block travels as a
   count, so no bucket holds a frequent shingle's documents. What a block needs back unchanged passes under a key of its own.
2. Equal sets become one class, which is represented by its smallest doc_id.
3. Shingles are ordered by frequency, rare ones first. Sets of n shingles that are similar enough share one of their first
   n - ceil(0.75 n) + 1; a class whose prefix has only shingles of its own is done. Classes with identical prefix and size form one group.
4. Groups that share a prefix shingle form pairs, which are filtered by size and by the place of the shingle; the pairs that are left are
   expanded to their classes and verified on whole sets.

Components need no link between classes that are connected already, so step 4 runs three times, and what is linked gets one label after
each. Twice it only takes stars: every class of a group with the group's head, and of each shingle's groups one per label with the first.
The third time it takes every pair of groups with different labels that share a shingle: no pair is left out, and a large group of near
copies, which has one label by then, costs pairs in proportion to its size. Shingles with many groups are salted.

Null and empty texts have empty sets, which are linked with nothing. A null doc_id has a null component. Repeated rows get equal results; rows
of one doc_id with different texts count by their texts. doc_id is a number; other columns are not read, whatever their names. A text of any
length has its whole set. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frees_batches, frees_group, written

SHINGLE = 5
#: Similarity as a fraction: 75 / 100.
SIMILAR, OF = 75, 100
BLOCK_SHINGLES = 2_000_000
BLOCK_DOCS = 60_000
#: From so many sets in a block a shingle travels as a count.
FREQUENT = 128
BUCKET_SHINGLES = 1_000_000
#: Bits of a bucket's number; 32 are enough for 2 ** 52 shingles.
BUCKET_BITS = (6, 32)
#: Shingles with more groups than this are salted; there is room for so many such shingles in a broadcast.
HOT_GROUPS, HOT_SHINGLES = 2_000, 100_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
COLD, HOT, HOT_REFS, DOCS = range(4)
_PACKED = "bucket long, block long, kind int, a binary, b binary, c binary"
_SETS = "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, tokens binary"
#: A class is named by its smallest doc_id and a part of its set's hash, as texts of one doc_id may differ.
_CLASS = "struct<id:bigint,s1:bigint>"


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text; keeps the hashes of the words it has met."""

    most = 400_000

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if len(words) < SHINGLE:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64)
        got = list(map(self.known.get, words))
        if None in got:
            if len(self.known) > self.most:
                self.known.clear()
            for i, x in enumerate(got):
                if x is None:
                    got[i] = self.known[words[i]] = xxhash.xxh3_64_intdigest(words[i])
        h = np.array(got, np.uint64)
        n = len(h) - SHINGLE + 1
        out = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            out = (out ^ (h[k : k + n] * _ODD[k])) * _ODD[(k + 1) % SHINGLE]
            out ^= out >> np.uint64(29)
        return np.unique(out)


class _Block:
    """Distinct sets of a run of documents."""

    def __init__(self):
        self.ids, self.sizes, self.marks, self.sets, self.at = [], [], [], [], []
        self.seen: dict[bytes, int] = {}
        self.shingles = 0

    def add(self, doc_id: int, text_hash: int, shingles: np.ndarray) -> None:
        mark = xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else b"\0" * 16
        if len(shingles) and mark not in self.seen:
            self.seen[mark] = len(self.sizes)
            self.sets.append(shingles)
            self.at.append(len(self.sizes))
            self.shingles += len(shingles)
        self.ids += doc_id, text_hash
        self.sizes.append(len(shingles))
        self.marks.append(mark)

    def rows(self, block: int, bits: int) -> Iterator[tuple]:
        """Rows of _PACKED: the documents, and the shingles by bucket."""
        alone = -1 - block  # a key that no bucket and no other block has
        yield alone, block, DOCS, np.array(self.ids, "<i8").tobytes(), np.array(self.sizes, "<u4").tobytes(), b"".join(self.marks)
        if not self.sets:
            return
        all_shingles = np.concatenate(self.sets)
        owners = np.repeat(np.array(self.at, "<u2"), [len(s) for s in self.sets])
        values, counts = np.unique(all_shingles, return_counts=True)
        frequent = counts >= FREQUENT
        if frequent.any():
            hot, n = values[frequent], counts[frequent]
            at = np.minimum(np.searchsorted(hot, all_shingles), len(hot) - 1)
            is_hot = hot[at] == all_shingles
            yield alone, block, HOT_REFS, all_shingles[is_hot].tobytes(), owners[is_hot].tobytes(), b""
            all_shingles, owners = all_shingles[~is_hot], owners[~is_hot]
            yield from self._by_bucket(block, bits, HOT, hot, n.astype("<u4"))
        yield from self._by_bucket(block, bits, COLD, all_shingles, owners)

    @staticmethod
    def _by_bucket(block: int, bits: int, kind: int, shingles: np.ndarray, with_: np.ndarray) -> Iterator[tuple]:
        bucket = shingles >> np.uint64(64 - bits)
        order = np.argsort(bucket, kind="stable")
        found, starts = np.unique(bucket[order], return_index=True)
        sent, with_ = shingles[order].astype("<u8"), with_[order]
        for k, a, b in zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(sent)], strict=True):
            yield k, block, kind, sent[a:b].tobytes(), with_[a:b].tobytes(), b""


def _pack(bits: int) -> Callable:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, block, number = Shingler(), _Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text_hash, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("text"), strict=True):
                block.add(doc_id, text_hash, shingler(text.as_py()))
                if block.shingles >= BLOCK_SHINGLES or len(block.sizes) >= BLOCK_DOCS:
                    yield out(list(block.rows(number, bits)))
                    block, number = _Block(), number + 1
        if block.ids:
            yield out(list(block.rows(number, bits)))

    return run


def _count_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """The shingles of a bucket that occur in two sets or more, to each block its own, with the number of sets; other rows pass."""
    made = []
    counted = [(r, np.frombuffer(r.a, "<u8")) for r in rows.itertuples() if r.kind in (COLD, HOT)]
    if counted:
        tokens = np.concatenate([t for _, t in counted])
        weights = np.concatenate([np.frombuffer(r.b, "<u4") if r.kind == HOT else np.ones(len(t)) for r, t in counted])
        _, inverse = np.unique(tokens, return_inverse=True)
        sets = np.bincount(inverse, weights=weights).astype("<u4")
        ends = np.cumsum([0, *[len(t) for _, t in counted]])
        for (r, t), a, b in zip(counted, ends, ends[1:], strict=False):
            n = sets[inverse[a:b]]
            often = n >= 2
            if often.any():
                made.append((r.block, r.kind, t[often].tobytes(), np.frombuffer(r.b, "<u2")[often].tobytes() if r.kind == COLD else b"", n[often].tobytes()))
    made += [(r.block, r.kind, r.a, r.b, r.c) for r in rows.itertuples() if r.kind in (HOT_REFS, DOCS)]
    return pd.DataFrame(made, columns=["block", "kind", "a", "b", "c"])


def prefix_length(n):
    """Sets of n shingles and a similar one share one of their first so many."""
    return n - (SIMILAR * n + OF - 1) // OF + 1


def _sets_of_block(rows: pd.DataFrame) -> pd.DataFrame:
    """A row of _SETS for each document; tokens, rare first, where the prefix reaches shingles of other sets."""

    def joined(kind: int, column: str, dtype: str) -> np.ndarray:
        return np.frombuffer(b"".join(rows[column][rows.kind == kind]), dtype)

    ids, sizes = joined(DOCS, "a", "<i8").reshape(-1, 2), joined(DOCS, "b", "<u4").astype(np.int64)
    marks = joined(DOCS, "c", "<i8").reshape(-1, 2)
    hot, hot_sets = joined(HOT, "a", "<u8"), joined(HOT, "c", "<u4")
    order = np.argsort(hot)
    refs = joined(HOT_REFS, "a", "<u8")
    ref_sets = hot_sets[order][np.searchsorted(hot[order], refs)] if len(refs) else np.zeros(0, "<u4")
    tokens = np.concatenate([joined(COLD, "a", "<u8"), refs])
    owners = np.concatenate([joined(COLD, "b", "<u2"), joined(HOT_REFS, "b", "<u2")]).astype(np.int64)
    sets = np.concatenate([joined(COLD, "c", "<u4"), ref_sets])
    order = np.lexsort((tokens, sets, owners))
    tokens, ends = tokens[order].astype("<u8"), np.searchsorted(owners[order], np.arange(len(ids) + 1))
    shared = np.diff(ends)
    reaches = (shared > 0) & (sizes - shared < prefix_length(sizes))
    blobs = [tokens[ends[k] : ends[k + 1]].tobytes() if reaches[k] else None for k in range(len(ids))]
    return pd.DataFrame({"doc_id": ids[:, 0], "text_hash": ids[:, 1], "n_shingles": sizes, "s1": marks[:, 0], "s2": marks[:, 1], "tokens": blobs})


def shingle_sets(docs: DataFrame) -> DataFrame:
    """_SETS of docs, which have doc_id, text_hash and text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(size / 7 / BUCKET_SHINGLES, 1))), *BUCKET_BITS))
    packed = docs.mapInArrow(frees_batches(_pack(bits)), _PACKED)
    counted = packed.groupBy("bucket").applyInPandas(frees_group(_count_bucket), "block long, kind int, a binary, b binary, c binary")
    return counted.groupBy("block").applyInPandas(frees_group(_sets_of_block), _SETS)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefix of each class: its shared shingles as an array, and how many of its own come before them."""
    for batch in batches:
        prefixes, own = [], []
        for n, blob in zip(batch.column("n_shingles").to_pylist(), batch.column("tokens"), strict=True):
            tokens = np.frombuffer(blob.as_py(), "<i8")
            own.append(n - len(tokens))
            prefixes.append(tokens[: prefix_length(n) - own[-1]])
        ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*prefixes, np.zeros(0, "<i8")]), pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n_shingles"), pa.array(own, pa.int64()), lists], names=["rep", "n", "own", "prefix"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets are similar."""
    for batch in batches:
        kept = []
        columns = [batch.column(c).to_pylist() for c in ("na", "nb", "ta", "tb")]
        for na, nb, ta, tb in zip(*columns, strict=True):
            both = len(np.intersect1d(np.frombuffer(ta, "<u8"), np.frombuffer(tb, "<u8"), assume_unique=True))
            kept.append(OF * both >= SIMILAR * (na + nb - both))
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _sizes_fit(na: Column, nb: Column) -> Column:
    return OF * F.least(na, nb) >= SIMILAR * F.greatest(na, nb)


def _overlap_fits(a: str, b: str) -> Column:
    """Whether sets whose first common shingle stands at these places can be similar."""
    reach = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    return (OF + SIMILAR) * reach >= SIMILAR * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def contract(edges: DataFrame, tables: Scratch) -> DataFrame:
    """u and root, the smallest node that is connected with u, of all nodes of the edges (u, v) that aren't such a root themselves.

    Nodes hang on their smallest neighbour, pointers are doubled until all point at roots, and the edges between roots are the next round's.
    """
    edges = tables.keep(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    roots = None
    while roots is None or not edges.isEmpty():
        hung = tables.keep(edges.groupBy(F.col("v").alias("u")).agg(F.min("u").alias("root")).withColumn("moved", F.lit(True)))
        while not hung.where("moved").isEmpty():
            above = hung.select(F.col("u").alias("root"), F.col("root").alias("top"))
            higher = tables.keep(hung.join(above, "root", "left").select("u", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
            tables.drop(hung)
            hung = higher
        hung = hung.drop("moved") if roots is None else hung.select("u", "root")
        to = lambda c: hung.select(F.col("u").alias(c), F.col("root").alias(f"r{c}"))  # noqa: B023, E731
        ends = edges.join(to("u"), "u", "left").join(to("v"), "v", "left").select(F.coalesce("ru", "u").alias("x"), F.coalesce("rv", "v").alias("y"))
        left = tables.keep(ends.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).where("u <> v").distinct())
        merged = hung if roots is None else roots.join(to("root"), "root", "left").select("u", F.coalesce("rroot", "root").alias("root")).unionByName(hung)
        roots = tables.keep(merged)
        tables.drop(edges)
        edges = left
    return roots


class _Join:
    """The groups of classes, and what is connected so far.

    labels: rep and label of the classes that have another label than themselves.
    """

    def __init__(self, classes: DataFrame, tables: Scratch):
        self.classes, self.tables, self.labels = classes, tables, None
        prefixes = tables.keep(classes.mapInArrow(_prefixes, f"rep {_CLASS}, n long, own long, prefix array<bigint>"))
        grouped = prefixes.select("rep", "n", F.xxhash64("prefix").alias("k1"), F.xxhash64(F.lit(1), "prefix").alias("k2"))
        heads = grouped.groupBy("k1", "k2", "n").agg(F.min("rep").alias("gid"))
        self.members = tables.keep(grouped.join(heads, ["k1", "k2", "n"]).select("gid", "rep"))
        head_rows = prefixes.join(self.members.where("gid = rep").select("rep"), "rep")
        postings = head_rows.select(F.col("rep").alias("gid"), "n", "own", F.posexplode("prefix").alias("i", "key")).select("gid", "n", "key", (F.col("own") + F.col("i")).alias("pos"))
        self.postings = tables.keep(postings)
        tables.drop(prefixes)

    def units(self) -> DataFrame:
        """gid, label, head: the groups, cut by label."""
        labelled = self.members if self.labels is None else self.members.join(self.labels, "rep", "left")
        label = F.col("rep") if self.labels is None else F.coalesce("label", "rep")
        return labelled.select("gid", "rep", label.alias("label"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that are links."""
        side = lambda c: self.classes.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("tokens").alias(f"t{c}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").where(_sizes_fit(F.col("na"), F.col("nb"))).mapInArrow(_linked, f"a {_CLASS}, b {_CLASS}")

    def connect(self, pairs: DataFrame) -> None:
        """Verifies the pairs and gives one label to what they link."""
        links = self.tables.keep(self.verified(pairs.distinct()))
        if self.labels is None:
            self.labels = self.tables.keep(contract(links.toDF("u", "v"), self.tables).toDF("rep", "label"))
            return
        to = lambda c: self.labels.select(F.col("rep").alias(c), F.col("label").alias(f"l{c}"))
        ends = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("la", "a").alias("u"), F.coalesce("lb", "b").alias("v"))
        roots = contract(ends, self.tables).toDF("label", "root")
        old = self.labels.join(roots, "label", "left").select("rep", F.coalesce("root", "label").alias("label"))
        more = roots.select(F.col("label").alias("rep"), F.col("root").alias("label"))
        self.tables.drop(links)
        self.labels = self.tables.keep(old.unionByName(more))

    @staticmethod
    def salted(rows: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows with a salt that deals those of a key with many groups, and the rows of stats (key, m) for each salt of their key."""
        hot_from = max(HOT_GROUPS, (stats.agg(F.sum("m")).first()[0] or 0) // HOT_SHINGLES)  # so there are HOT_SHINGLES of them at most
        salts = F.greatest(F.ceil(F.col("m") / hot_from).cast("int"), F.lit(1))
        hot = F.broadcast(stats.where(F.col("m") > hot_from).select("key", salts.alias("salts")))
        dealt = rows.join(hot, "key", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("gid"), "salts"), F.lit(0))).drop("salts")
        return dealt, stats.withColumn("salts", salts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    def stars(self) -> DataFrame:
        """Pairs (a, b): every class with its group's head, and of each shingle's groups one per label with the first."""
        units = self.units()
        inside = units.where("rep <> gid").select(F.col("gid").alias("a"), F.col("rep").alias("b"))
        if self.labels is not None:  # what has the head's label needs no other link
            heads = units.where("rep = gid").select("gid", F.col("label").alias("l"))
            inside = units.where("rep <> gid").join(heads, "gid").where("label <> l").select(F.col("gid").alias("a"), F.col("rep").alias("b"))
        lists = self.postings
        if self.labels is not None:
            lists = lists.join(units.where("rep = gid").select("gid", "label"), "gid")
            lists = lists.groupBy("key", "label").agg(F.min_by(F.struct("gid", "n", "pos"), "gid").alias("g")).select("key", "g.*")
        lists = self.tables.keep(lists)
        first = lists.groupBy("key").agg(F.count("*").alias("m"), F.min_by(F.struct("gid", "n", "pos"), "gid").alias("h")).where("m > 1")
        first = self.tables.keep(first.select("key", "m", "h.*"))
        dealt, hubs = self.salted(lists, first)
        met = dealt.alias("o").join(hubs.alias("h"), ["key", "salt"]).where("o.gid <> h.gid").where(_sizes_fit(F.col("o.n"), F.col("h.n")) & _overlap_fits("o", "h"))
        return inside.unionByName(met.select(F.col("h.gid").alias("a"), F.col("o.gid").alias("b")))

    def rest(self) -> DataFrame:
        """Pairs (a, b) of classes with different labels whose groups share a shingle and pass the filters."""
        units = self.tables.keep(self.units())
        parts = units.select("gid", "label").distinct()
        lists = self.postings.join(parts, "gid").select("key", "gid", "label", "n", "pos")
        by_label = lists.groupBy("key", "label").agg(F.count("*").alias("k"))
        stats = by_label.groupBy("key").agg(F.sum("k").alias("m"), F.max_by("label", "k").alias("most"), F.count("*").alias("labels")).where("labels > 1")
        stats = self.tables.keep(stats.select("key", "m", "most"))
        dealt, keys = self.salted(lists, stats)
        open_lists = self.tables.keep(dealt.join(keys.select("key", "salt", "most", "salts"), ["key", "salt"]))
        # of two labels one at least isn't the most frequent
        fewer = open_lists.where("label <> most").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        met = fewer.alias("h").join(open_lists.alias("o"), ["key", "salt"]).where("o.label <> h.label")
        met = met.where(_sizes_fit(F.col("o.n"), F.col("h.n")) & _overlap_fits("o", "h"))
        one, two = F.struct("h.gid", "h.label"), F.struct("o.gid", "o.label")
        groups = met.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).distinct()
        groups = self.tables.keep(groups.select(F.col("x.gid").alias("ga"), F.col("x.label").alias("la"), F.col("y.gid").alias("gb"), F.col("y.label").alias("lb")))
        side = lambda c: units.select(F.col("gid").alias(f"g{c}"), F.col("label").alias(f"l{c}"), F.col("rep").alias(c))
        return groups.join(side("a"), ["ga", "la"]).join(side("b"), ["gb", "lb"]).select("a", "b")


def components(classes: DataFrame, tables: Scratch) -> DataFrame:
    """rep and label of those of the classes (rep, n_shingles, tokens) whose label, the smallest class they are connected with, is another one."""
    join = _Join(classes, tables)
    join.connect(join.stars())
    join.connect(join.stars())
    join.connect(join.rest())
    return join.labels


def _labelled(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_hash, n_shingles and component (a class; null without words) of the rows that have a doc_id."""
    tables = Scratch(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    found = tables.keep(shingle_sets(rows.where(F.col("doc_id").isNotNull()).withColumn("text_hash", F.xxhash64("text"))))
    by_set = found.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n_shingles"), F.max("tokens").alias("tokens"))
    classes = tables.keep(by_set.select("s1", "s2", F.struct("id", "s1").alias("rep"), "n_shingles", "tokens"))
    sets = tables.keep(found.drop("tokens"))
    tables.drop(found)
    labels = components(classes.where(F.col("tokens").isNotNull()).select("rep", "n_shingles", "tokens"), tables)
    named = tables.keep(classes.select("s1", "s2", "rep").join(labels, "rep", "left").select("s1", "s2", F.coalesce("label", "rep").alias("component")))
    tables.drop(classes)
    return sets.join(named, ["s1", "s2"], "left").select("doc_id", "text_hash", "n_shingles", "component")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    given = _labelled(docs, doc_id, text).select("doc_id", "n_shingles", F.coalesce("component.id", "doc_id").alias("component_id"))
    nameless = docs.where(F.col(f"`{doc_id}`").isNull()).select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return given.unionByName(nameless.mapInArrow(_sizes_only, "doc_id long, n_shingles long, component_id long"))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id, of its texts the one with the smallest hash.

    Rows without words stay, but for repeated ones; rows without doc_id stay all. Repeated rows are those of one doc_id and text.
    """
    found = written(_labelled(docs, doc_id, text))
    row = F.struct("doc_id", "text_hash")
    kept = found.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(row).alias("kept")).select("kept.*", F.lit(True).alias("stays"))
    by_row = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.max("component").isNotNull().alias("grouped"))
    judged = by_row.join(kept, ["doc_id", "text_hash"], "left").withColumn("goes", F.col("grouped") & F.col("stays").isNull())
    odd = written(judged.where("goes or n > 1").select("doc_id", "text_hash", "goes"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("text_hash"))
    plain = whole.join(odd, ["doc_id", "text_hash"], "left_anti")
    once = whole.join(odd.where("not goes"), ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return plain.unionByName(once).select("row.*")


def _sizes_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        n = pa.array([len(shingler(t.as_py())) for t in batch.column("text")], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, batch.column("doc_id")], names=["doc_id", "n_shingles", "component_id"])
