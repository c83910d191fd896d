import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from devicelogs.llm import merkle as m
from devicelogs.llm.query_11 import op11_merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*values):
    piece = lambda v: b"-" if v is None else str(len(str(v).encode())).encode() + b":" + str(v).encode()
    return hashlib.sha256(b"".join(map(piece, values))).hexdigest()


def digest(*hexes):
    """Lengths stand before a leaf's columns alone, digests follow one another as hex text."""
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


def parents(nodes):
    return [digest(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]


def path(nodes, at):
    """Siblings of a node up to the top: lists of (left, right)."""
    found = []
    while len(nodes) > 1:
        run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
        found.append((run[: at % 16], run[at % 16 + 1 :]))
        nodes, at = parents(nodes), at // 16
    return found, nodes[0]


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((H(r[0], r[3], r[2], r[4], r[1]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, bytes.fromhex(x[0])))
    tops = [path([x[0] for x in by[s]], 0)[1] for s in order]
    out = []
    for k, s in enumerate(order):
        hashes = [x[0] for x in by[s]]
        above, root = path(tops, k)
        for at, (leaf, r) in enumerate(by[s]):
            below, subroot = path(hashes, at)
            steps = below + above
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            folded = H(r[0], r[3], r[2], r[4], lowered(r[1])) if cut else leaf
            for left, right in steps:
                folded = digest(*left, folded, *right)
            proof = digest(*[x for left, right in steps for x in left + right])
            out.append((r[0], leaf, subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()], key=str)


def table(n, sources, seed=0):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "lower only", "Mixed Case é ÀB", "X" * rng.randint(1, 3000)])
    return [(k, text(), rng.choice(["en", None]), rng.choice(sources), rng.choice([None, k])) for k in range(n)]


@pytest.mark.parametrize("rows", [
    table(400, ["a"], 1), table(700, [None, "b", "é", "z", "Z"], 2), [(k, "T", "en", f"s{k:03}", 1) for k in range(40)],  # lone leaves only
    [(1, "One", None, None, None)], [(7, "Two", "en", "a", 3)] * 3 + [(None, "N", "en", "a", 1)] * 18 + table(17, ["b"]),
])
def test_manifest_against_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(m.manifest(docs, share=20)) == brute(rows)


def test_digests_are_hashed_as_plain_hex_text(spark):
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    a, b, c = sha("1:1" "1:s" "2:en" "1:3" "3:One"), sha("1:2" "1:s" "-" "-" "-"), sha("1:3" "1:t" "2:de" "1:2" "2:é")
    docs = spark.createDataFrame([(1, "One", "en", "s", 3), (2, None, None, "s", None), (3, "é", "de", "t", 2)], SCHEMA)
    root = sha(sha(a + b) + c)
    assert got(m.manifest(docs)) == [
        (1, a, sha(a + b), root, sha(b + c), root, True), (2, b, sha(a + b), root, sha(a + c), root, True), (3, c, c, root, sha(sha(a + b)), root, True),
    ]


def test_tampering_is_found(spark):
    rows = [(k, "Upper" if k % 2 else "lower", "en", "ab"[k % 2], 5) for k in range(300)]
    found = {r.doc_id: r.verified for r in m.manifest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {k: not (k % 2 and zlib.crc32(str(k).encode()) % 5 == 0) for k in range(300)}


def test_empty_extra_and_settings(spark):
    docs = spark.createDataFrame([(k, "T", "en", "a", 1, "x", 2) for k in range(20)], SCHEMA + ", leaf string, `Tree` int")
    assert got(m.manifest(docs)) == brute([(k, "T", "en", "a", 1) for k in range(20)])
    assert m.manifest(docs.limit(0)).count() == 0
    assert int(spark.conf.get("spark.sql.cteRecursionRowLimit")) > 0


def test_query_on_the_small_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    assert got(op11_merkle_manifest(spark, "/root/testdata/sf0.001")) == brute([tuple(r) for r in rows])
