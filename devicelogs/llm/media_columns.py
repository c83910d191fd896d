"""Media columns: payloads in tar shards, addressed by content, with metadata columns from header-only reads.

Spark computes the SHA-256 of every payload and shuffles the digests alone: of rows with equal payloads, the one with the smallest doc_id
stores it. Tasks pack what their rows store as lossless 8-bit grey PNG members, named by digest, into tar shards in the shared folder, so a
digest has one member in the corpus. Rows carry digest, shard, offset and length. ``header_columns`` fills metadata by a ranged read of each
member's first 33 bytes; ``read_payloads`` reads members back, checks them against their digest and computes features.

Null and empty texts become one line of padding. Rows that are equal, doc_id included, may be stored by two tasks; one of the members is in
the index. Equal payloads get equal values whatever the doc_id, which keeps its type; other columns are not read. A payload of any length is
one member. An empty table gives an empty result. A task that is run again writes a shard of another name; the index names only the shards
of the attempts that were committed.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

WIDTH = 192
#: A shard is closed when it has this many bytes.
SHARD_BYTES = 256 * 1024 * 1024
#: PNG signature and the IHDR chunk.
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_STORED = "doc_id {kind}, digest string, shared boolean, shard string, offset long, length long, n_bytes long"
#: More digests of several rows than this are joined by a shuffle instead of a broadcast.
BROADCAST_DIGESTS = 200_000
#: Members of a shard that lie closer than this are fetched by one read.
READ_BYTES = 4 * 1024 * 1024


def payload(text: str | None) -> bytes:
    """UTF-8, with spaces up to a positive multiple of WIDTH."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b" ")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    """An 8-bit grey image of WIDTH samples a row."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row begins with its filter: none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first HEADER_BYTES."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != int.from_bytes(head[29:33], "big"):
        raise ValueError("not the header of a PNG file")
    return struct.unpack(">IIBB", head[16:26])


def from_png(png: bytes) -> bytes:
    """The samples of an image written by to_png."""
    width, height, depth, colour = png_header(png[:HEADER_BYTES])
    at, data = HEADER_BYTES, b""
    while at < len(png):
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        if kind == b"IDAT":
            data += png[at + 8 : at + 8 + size]
        at += size + 12
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if (depth, colour) != (8, 0) or lines[:, 0].any():
        raise ValueError("not an unfiltered 8-bit grey image")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation and a 64-bit average hash over an 8 x 8 grid of the image."""
    x = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH).astype(np.float64)
    rows = (np.arange(9) * len(x)) // 8
    sums = np.vstack([np.zeros(WIDTH), np.cumsum(x, axis=0)])
    top, bottom = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1)
    bands = (sums[bottom] - sums[top]) / (bottom - top)[:, None]
    cells = bands.reshape(8, 8, WIDTH // 8).mean(axis=2)
    bits = np.packbits(cells > cells.mean()).tobytes().hex()
    return f"{x.mean():.4f}:{x.std():.4f}:{bits}"


class _ShardWriter:
    """Appends members to tar shards and starts a new one where one is full."""

    def __init__(self, folder: str):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.folder, self.out, self.tar = folder, None, None

    def add(self, digest: str, data: bytes) -> tuple[str, int, int]:
        if self.tar is None:
            self.name, self.members = f"{uuid.uuid4().hex}.tar", {}
            self.out = self.store.open_output_stream(f"{self.root}/{self.name}")
            self.tar, self.at = tarfile.open(fileobj=_Counted(self.out), mode="w|", format=tarfile.USTAR_FORMAT), 0
        if digest not in self.members:
            info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
            info.size = len(data)
            self.tar.addfile(info, io.BytesIO(data))
            self.members[digest] = (f"{self.folder}/{self.name}", self.at + 512, len(data))
            self.at += 512 + -(-len(data) // 512) * 512
        found = self.members[digest]
        if self.at >= SHARD_BYTES:
            self.close()
        return found

    def close(self) -> None:
        if self.tar is not None:
            self.tar.close()
            self.out.close()
            self.tar = None


class _Counted:
    """What tarfile's stream mode needs of a file."""

    def __init__(self, out):
        self.out = out

    def write(self, data: bytes) -> int:
        self.out.write(data)
        return len(data)


def _write_shards(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _ShardWriter(folder)
        for batch in batches:
            rows: list[tuple] = []
            for text, digest, stores in zip(batch.column("text"), batch.column("digest").to_pylist(), batch.column("stores").to_pylist(), strict=True):
                text = text.as_py() or ""
                place = (None, None, None)
                if stores:
                    data = payload(text)
                    if hashlib.sha256(data).hexdigest() != digest:
                        raise ValueError("Spark and Python disagree on a payload")
                    place = shards.add(digest, to_png(data))
                rows.append((*place, len(text.encode("utf-8", "surrogatepass"))))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "digest", "shared")], *arrays], names=["doc_id", "digest", "shared", "shard", "offset", "length", "n_bytes"])
        shards.close()

    return run


def _local(uri: str) -> str:
    return uri if "://" in uri else f"file://{uri}"


def _digest(text: Column) -> Column:
    """The SHA-256 of a text's payload."""
    size = F.octet_length(text)
    room = F.when(size == 0, WIDTH).otherwise(F.pmod(-size, F.lit(WIDTH)))
    return F.sha2(F.concat(text, F.repeat(F.lit(" "), room.cast("int"))), 256)


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_DIGESTS else table


def _stored(docs: DataFrame, folder: str | None, doc_id: str, text: str) -> DataFrame:
    """Writes the shards. Per row: doc_id, digest, whether several rows share it, n_bytes, and the member's place if this row stored it."""
    folder = _local(folder or f"{shared_dir(docs.sparkSession)}-shards")
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).withColumn("digest", _digest(F.col("text")))
    several = written(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("storer")).where("n > 1").select("digest", "storer", F.lit(True).alias("shared")))
    marked = rows.join(_small(several), "digest", "left").withColumn("stores", F.col("shared").isNull() | F.col("doc_id").eqNullSafe(F.col("storer")))
    marked = marked.select("doc_id", "text", "digest", F.coalesce("shared", F.lit(False)).alias("shared"), "stores")
    return written(marked.mapInArrow(_write_shards(folder), _STORED.format(kind=dict(rows.dtypes)["doc_id"])))


_PLACE = ["shard", "offset", "length"]


def members(stored: DataFrame) -> DataFrame:
    """digest, shard, offset and length: one member for each digest that rows share."""
    there = stored.where("shared and shard is not null")
    return there.groupBy("digest").agg(F.min(F.struct(*_PLACE)).alias("m")).select("digest", "m.*")


def store_payloads(docs: DataFrame, folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards and returns the index: doc_id, digest, n_bytes, shard, offset, length."""
    stored = _stored(docs, folder, doc_id, text)
    return stored.where("not shared").drop("shared").unionByName(stored.where("shared").select("doc_id", "digest", "n_bytes").join(_small(written(members(stored))), "digest"))


class _ShardReader:
    """Ranged reads of members; the open shard is kept from row to row."""

    def __init__(self):
        self.shard, self.file = None, None
        self.start, self.block = 0, b""

    def open(self, shard: str):
        if shard != self.shard:
            store, path = fs.FileSystem.from_uri(shard)
            self.shard, self.file, self.block = shard, store.open_input_file(path), b""
        return self.file

    def exactly(self, shard: str, offset: int, length: int) -> bytes:
        return self.open(shard).read_at(length, offset)

    def ahead(self, shard: str, offset: int, length: int) -> bytes:
        """As exactly, but fetches the neighbours that will be asked for next."""
        file = self.open(shard)
        if not self.start <= offset or offset + length > self.start + len(self.block):
            self.start, self.block = offset, file.read_at(max(READ_BYTES, length), offset)
        return self.block[offset - self.start : offset - self.start + length]


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = _ShardReader()
    for batch in batches:
        shards, offsets = batch.column("shard").to_pylist(), batch.column("offset").to_pylist()
        heads = [png_header(reader.exactly(s, o, HEADER_BYTES)) for s, o in zip(shards, offsets, strict=True)]
        columns = [pa.array([h[k] for h in heads], pa.int32()) for k in range(4)]
        names = [*batch.schema.names, "width", "height", "bit_depth", "colour_type"]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)


def header_columns(index: DataFrame) -> DataFrame:
    """The index with width, height, bit_depth and colour_type, read from the members' headers alone."""
    return index.mapInArrow(_headers, ", ".join([*[f"`{n}` {t}" for n, t in index.dtypes], "width int, height int, bit_depth int, colour_type int"]))


_READ = ["payload_bytes long", "payload_sha256 string", "tail_crc32 long", "media_bytes long", "media_sha256 string", "feature string"]


def _describe(png: bytes, digest: str) -> tuple:
    data = from_png(png)
    found = hashlib.sha256(data).hexdigest()
    if found != digest:
        raise ValueError(f"the member {digest} holds other bytes")
    return len(data), found, zlib.crc32(data[-16:]), len(png), hashlib.sha256(png).hexdigest(), feature(data)


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = _ShardReader()
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    known: dict[tuple[str, int], tuple] = {}
    for batch in batches:
        rows = []
        for digest, shard, offset, length in zip(*[batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")], strict=True):
            if (shard, offset) not in known:
                if len(known) >= 50_000:
                    known.clear()
                known[shard, offset] = _describe(reader.ahead(shard, offset, length), digest)
            rows.append(known[shard, offset])
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *[x.split()[0] for x in _READ]])


def read_payloads(index: DataFrame) -> DataFrame:
    """The index with what the members hold, read back from the shards."""
    return index.mapInArrow(_payloads, ", ".join([*[f"`{n}` {t}" for n, t in index.dtypes], *_READ]))


def media_columns(docs: DataFrame, folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores the payloads, then gives every row its place, the header's metadata and what was read back of its member."""
    stored = _stored(docs, folder, doc_id, text)
    own = read_payloads(header_columns(stored.where("not shared").select("doc_id", "digest", "n_bytes", *_PLACE)))
    once = written(read_payloads(header_columns(members(stored))))
    shared = stored.where("shared").select("doc_id", "digest", "n_bytes").join(_small(once), "digest")
    return own.unionByName(shared.select(*own.columns))
