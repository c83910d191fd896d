"""A Merkle manifest of a dataset, with proofs that a Spark recursive query climbs.

Every row is a leaf. Within a source leaves ascend by doc_id (rows that share one, by their hash); runs of FAN become their parent until one
node is left, the subroot; the subroots, ordered by source, likewise give the root. All hashing, ranking and climbing is Spark SQL.

Built levels are stored as one table of runs: a run's children, its own hash, and the key of its parent with its place there. The recursive
query starts from every leaf and every lowest run. A leaf folds its (perhaps tampered) hash with the siblings that it meets; a lowest run
appends the siblings that all its leaves share. A leaf's proof is its run's chain without itself.

No task holds a source: ranks come from a range partitioning and running counts per partition, and a run with many leaves below it is stored
in as many copies as keep SHARE leaves to each, so that a join never meets a hot key. The number of steps grows with the logarithm of rows.

A leaf is the hash of its columns, each with its length before it; a parent is the hash of its children's hex texts, one after the other, and
a proof likewise that of its siblings. Null columns hash as "-", and a null source is a source of its own, before all others. Rows with a null doc_id come first in their source
and are never tampered. Rows that are equal each get a result. Columns other than those of LEAF are not read. An empty table gives an empty
result; a single row is leaf, subroot and root at once, with an empty proof. Texts of any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FAN = 16
#: Leaves below one stored copy of a run.
SHARE = 4096
#: The columns of a leaf, in the order of hashing.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows are tampered where this divides the checksum of their doc_id.
TAMPER_EVERY = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BYTES = 32
_ROOT_TREE = -1


def _piece(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _hash(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(_piece, values)).cast("binary"), 256))


def _spelled(digests: str) -> str:
    """SQL for binary digests in a row as the inputs of a hash: their hex texts, without lengths."""
    return f"lower(hex({digests}))"


def _joined(digests: Column) -> Column:
    """An array of digests as one binary."""
    return F.unhex(F.array_join(F.transform(digests, F.hex), ""))


def leaf_hashes(docs: DataFrame, columns: Sequence[str] = LEAF, tamper: str = "text", every: int = TAMPER_EVERY) -> DataFrame:
    """doc_id, source, leaf and tampered: the hash of each row, and of the row after tampering (the same where it isn't tampered)."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    values = [F.col(f"`{c}`") for c in columns]
    changed = [F.translate(v.cast("string"), _UPPER, _LOWER) if c == tamper else v for c, v in zip(columns, values, strict=True)]
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), _hash(*values).alias("leaf"), F.when(chosen, _hash(*changed)).alias("_other"))
    return rows.select("doc_id", "source", "leaf", F.coalesce("_other", "leaf").alias("tampered"))


def ranked(leaves: DataFrame) -> DataFrame:
    """leaves with tree (the number of the source in its order), size (rows of the source) and at (the row's rank in it), all from zero."""
    placed = written(leaves.repartitionByRange("source", "doc_id", "leaf").withColumn("part", F.spark_partition_id()))
    counts = written(placed.groupBy("source", "part").agg(F.count("*").alias("n")))  # a few rows for each partition
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    per_source = counts.groupBy("source").agg(F.sum("n").alias("size"), F.min("part").alias("part"))
    starts = per_source.groupBy("part").agg(F.count("*").alias("k")).select("part", F.coalesce(F.sum("k").over(before(Window.partitionBy(F.lit(0)).orderBy("part"))), F.lit(0)).alias("start"))
    numbered = per_source.withColumn("local", F.row_number().over(Window.partitionBy("part").orderBy("source")) - 1).join(starts, "part")
    trees = numbered.select(F.col("source").alias("_source"), (F.col("start") + F.col("local")).cast("long").alias("tree"), "size")
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before(Window.partitionBy("source").orderBy("part"))), F.lit(0)))
    offsets = offsets.join(trees, F.col("source").eqNullSafe(F.col("_source"))).select("_source", F.col("part").alias("_part"), "offset", "tree", "size")
    rank = F.row_number().over(Window.partitionBy("tree", "part").orderBy("doc_id", "leaf"))
    found = placed.join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
    return found.select("doc_id", "leaf", "tampered", "tree", "size", (F.col("offset") + rank - 1).cast("long").alias("at"))


def _runs(members: DataFrame, level: int, fan: int) -> DataFrame:
    """The runs of members (tree, at, size, hash, leaves)."""
    run = F.floor(F.col("at") / fan).alias("run")
    made = members.groupBy("tree", "size", run).agg(F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("k"), F.sum("leaves").alias("leaves"))
    made = made.select("tree", F.lit(level).alias("level"), "run", "size", "leaves", _joined(F.col("k.hash")).alias("kids"))
    single = F.col("size") == 1  # a lone leaf is its own subroot
    made = made.withColumn("hash", F.when(single, F.col("kids")).otherwise(F.unhex(F.sha2(F.expr(_spelled("kids")).cast("binary"), 256))))
    return made.select("tree", "level", "run", "leaves", "kids", "hash", single.alias("passes"), F.ceil(F.col("size") / fan).cast("long").alias("next_size"))


def _tree(members: DataFrame, fan: int) -> tuple[list[DataFrame], DataFrame]:
    """The written levels of trees, and of each tree the top run."""
    levels = []
    while True:
        runs = written(_runs(members, len(levels), fan))
        levels.append(runs)
        rest = runs.where("next_size > 1")
        if rest.isEmpty():
            tops = [r.where("next_size = 1") for r in levels]
            top = tops[0]
            for t in tops[1:]:
                top = top.unionByName(t)
            return levels, top
        members = rest.select("tree", F.col("run").alias("at"), F.col("next_size").alias("size"), "hash", "leaves")


def _linked(levels: list[DataFrame], n_trees: int, fan: int, share: int) -> DataFrame:
    """All runs with the keys of their parents; those with many leaves below in several copies."""
    rows = levels[0]
    for r in levels[1:]:
        rows = rows.unionByName(r)
    inner, to_root = F.col("next_size") > 1, (F.col("tree") != _ROOT_TREE) & F.lit(n_trees > 1)
    step = lambda here, there: F.when(inner, here).when(to_root, there)
    rows = rows.withColumns({
        "top": ~inner & (F.col("tree") != _ROOT_TREE), "copies": (F.floor(F.col("leaves") / share) + 1).cast("long"),
        "up_tree": step(F.col("tree"), F.lit(_ROOT_TREE).cast("long")), "up_level": step(F.col("level") + 1, F.lit(0)), "up_run": step(F.floor(F.col("run") / fan), F.floor(F.col("tree") / fan)), "up_place": step(F.col("run") % fan, F.col("tree") % fan)})
    above = rows.select(F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("run").alias("up_run"), F.col("copies").alias("up_copies"))
    linked = rows.join(above, ["up_tree", "up_level", "up_run"], "left")
    return linked.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))


_LEFT = f"substring(n.kids, 1, c.place * {_BYTES})"
_RIGHT = f"substring(n.kids, c.place * {_BYTES} + {_BYTES + 1})"
_FOLDED = _spelled(f"concat({_LEFT}, c.state, {_RIGHT})")
_CLIMB = f"""
WITH RECURSIVE climb AS (
  SELECT * FROM {{start}}
  UNION ALL
  SELECT c.doc_id, c.leaf, c.own_tree, c.own_run, c.own_place, c.seed,
    CASE WHEN n.passes THEN c.state
         WHEN c.leaf IS NULL THEN concat(c.state, {_LEFT}, {_RIGHT})
         ELSE unhex(sha2(CAST({_FOLDED} AS BINARY), 256)) END,
    CASE WHEN c.leaf IS NULL THEN coalesce(c.subroot, CASE WHEN n.top THEN n.hash END) END,
    CASE WHEN c.leaf IS NULL THEN n.hash END,
    n.up_tree, n.up_level, n.up_run, pmod(c.seed, n.up_copies), n.up_place
  FROM climb c JOIN {{nodes}} n ON c.tree = n.tree AND c.level = n.level AND c.run = n.run AND c.copy = n.copy
)
SELECT doc_id, leaf, own_tree, own_run, own_place, state, subroot, root FROM climb WHERE tree IS NULL"""


def climb(leaves: DataFrame, nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """The last rows of the recursive query: of leaves (leaf is not null) the folded hash, of lowest runs the chain, subroot and root."""
    spark = leaves.sparkSession
    place, nothing = F.col("at") % fan, F.lit(None).cast("binary")
    own = (F.col("tree").alias("own_tree"), F.floor(F.col("at") / fan).alias("own_run"), place.alias("own_place"))
    from_leaf = leaves.select(
        "doc_id", "leaf", *own, F.col("at").alias("seed"), F.col("tampered").alias("state"), nothing.alias("subroot"), nothing.alias("root"),
        "tree", F.lit(0).alias("level"), F.floor(F.col("at") / fan).alias("run"), F.lit(0).cast("long").alias("copy"), place.alias("place"))
    lowest = nodes.where((F.col("level") == 0) & (F.col("tree") != _ROOT_TREE) & (F.col("copy") == 0))
    from_run = lowest.select(
        F.lit(None).cast(dict(leaves.dtypes)["doc_id"]).alias("doc_id"), nothing.alias("leaf"), F.col("tree").alias("own_tree"), F.col("run").alias("own_run"), F.lit(None).cast("long").alias("own_place"), F.col("run").alias("seed"),
        F.col("kids").alias("state"), F.when(F.col("top"), F.col("hash")).alias("subroot"), F.col("hash").alias("root"),
        F.col("up_tree").alias("tree"), F.col("up_level").alias("level"), F.col("up_run").alias("run"), F.pmod("run", "up_copies").alias("copy"), F.col("up_place").alias("place"))
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # the query gives a row for each leaf and level
    try:
        return written(spark.sql(_CLIMB, start=from_leaf.unionByName(from_run), nodes=nodes))
    finally:
        spark.conf.set(limit, before)


def manifest(docs: DataFrame, fan: int = FAN, share: int = SHARE, columns: Sequence[str] = LEAF) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (hex) and verified of every row."""
    leaves = written(ranked(written(leaf_hashes(docs, columns))))
    levels, tops = _tree(leaves.select("tree", "at", "size", F.col("leaf").alias("hash"), F.lit(1).cast("long").alias("leaves")), fan)
    n_trees = tops.count()
    if n_trees > 1:
        levels += _tree(tops.select(F.lit(_ROOT_TREE).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(n_trees).cast("long").alias("size"), "hash", "leaves"), fan)[0]
    last = climb(leaves, written(_linked(levels, n_trees, fan, share)), fan)
    folded = last.where("leaf is not null").select("doc_id", "leaf", "own_tree", "own_run", "own_place", F.col("state").alias("folded"))
    chains = last.where("leaf is null").select("own_tree", "own_run", F.col("state").alias("chain"), F.coalesce("subroot", "root").alias("subroot"), "root")
    siblings = f"concat(substring(chain, 1, own_place * {_BYTES}), substring(chain, own_place * {_BYTES} + {_BYTES + 1}))"
    found = folded.join(chains, ["own_tree", "own_run"])
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select("doc_id", hexed("leaf"), hexed("subroot"), hexed("root"), F.sha2(F.expr(_spelled(siblings)).cast("binary"), 256).alias("proof_sha256"), F.lower(F.hex("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
