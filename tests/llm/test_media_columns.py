import hashlib
import tarfile
import zlib

from devicelogs.llm import media_columns as m

TEXTS = [None, "", "x", "é" * 96, "a" * 193, "same", "same", "long " * 40_000, "\x00\x01 odd"]


def test_round_trip_and_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, digest string").repartition(2)
    got = {r.doc_id: r for r in m.media_columns(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        size = max(192, -(-len(raw) // 192) * 192)
        data = raw + b" " * (size - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), size, hashlib.sha256(data).hexdigest())
        assert r.tail_crc32 == zlib.crc32(data[-16:]) and (r.width, r.height) == (192, size // 192)
        with open(r.shard.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            png = f.read(r.length)
        assert m.from_png(png) == data and (len(png), hashlib.sha256(png).hexdigest()) == (r.media_bytes, r.media_sha256)
    assert got[5].feature == got[6].feature and got[0].feature == got[1].feature


def test_shards_are_tar_files_addressed_by_content(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").coalesce(1)
    index = m.store_payloads(docs).collect()
    (shard,) = {r.shard for r in index}
    names = tarfile.open(shard.removeprefix("file://")).getnames()
    assert sorted(names) == sorted({f"{r.digest[:2]}/{r.digest}.png" for r in index}) and len(names) == len(set(TEXTS)) - 1


def test_a_digest_has_one_member_in_the_corpus(spark):
    rows = [(k, f"text {k % 7}") for k in range(60)] + [(None, "text 3"), (None, "alone"), (99, "twice"), (99, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    index = m.store_payloads(docs).collect()
    assert len(index) == len(rows)
    places = {}
    for r in index:
        places.setdefault(r.digest, set()).add((r.shard, r.offset, r.length))
    assert len(places) == 9 and all(len(p) == 1 for p in places.values())
    names = [n for shard in {r.shard for r in index} for n in tarfile.open(shard.removeprefix("file://")).getnames()]
    assert len(set(names)) == 9 and len(names) <= 10  # two tasks may store the row that comes twice
    got = m.media_columns(docs.withColumn("doc_id", docs.doc_id.cast("string"))).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)


def test_large_tables_of_digests_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(m, "BROADCAST_DIGESTS", 0)
    docs = spark.createDataFrame([(k, f"text {k % 5}") for k in range(20)], "doc_id long, text string")
    assert len({(r.payload_sha256, r.shard, r.offset) for r in m.media_columns(docs).collect()}) == 5


def test_empty_table(spark):
    assert m.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0
