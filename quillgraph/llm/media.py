"""Media columns: content-addressed payloads in tar shards.

A text becomes a grayscale PNG: its UTF-8 bytes, padded with spaces to rows of ``WIDTH`` samples. Tasks append images
to tar shards in the shared folder, one member per digest and shard, named by digest; rows carry digest, shard, offset and length. A
shard is written under a task's own name and moved to a name made from its content, so a repeated attempt leaves the
same file. Of equal digests in several shards the smallest (shard, offset) is the address of all rows. Metadata columns
come from range reads of the 33 header bytes; payload features from reading the stored bytes back, shard by shard.

The shards and the index live in ``<shared folder>/media-<uuid>``; executors reach it through ``pyarrow.fs``, so it may be any
store that pyarrow opens by URI.

Defined results: null and empty texts are one row of spaces with n_bytes 0; equal texts have equal values; repeated
rows and null doc_ids pass; texts of any length are stored whole; columns other than doc_id and text are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import shared_dir

WIDTH, LEVEL, HEADER = 192, 6, 33
#: Bytes after which a task starts its next shard.
SHARD_BYTES = 256 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, feature string"


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """A grayscale image of ``WIDTH`` samples a row, each row with filter 0."""
    height = len(payload) // WIDTH
    rows = b"".join(b"\0" + payload[i : i + WIDTH] for i in range(0, len(payload), WIDTH))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows, LEVEL)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int]:
    """Width and height from the first ``HEADER`` bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not an image header")
    return struct.unpack(">II", head[16:24])


def decode_png(image: bytes) -> bytes:
    """Samples of an image that ``encode_png`` wrote; checks every chunk."""
    width, height = read_header(image[:HEADER])
    at, data = 8, []
    while at < len(image):
        (n,) = struct.unpack(">I", image[at : at + 4])
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = zlib.decompress(b"".join(data))
    if len(rows) != height * (width + 1):
        raise ValueError("wrong size")
    return b"".join(rows[i + 1 : i + 1 + width] for i in range(0, len(rows), width + 1))


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Shards:
    """Writes one task's shards; remembers the digests of the shard at hand only."""

    def __init__(self, uri: str):
        self.fs, self.root = _open(uri)
        self.done: list[tuple[list, str]] = []
        self.out = None

    def start(self) -> None:
        self.name = f"{self.root}/.part-{uuid.uuid4().hex}"
        self.out, self.at, self.seen, self.rows, self.sum = self.fs.open_output_stream(self.name), 0, {}, [], hashlib.sha256()

    def add(self, doc_id, n_bytes: int, payload: bytes) -> None:
        if self.out is None:
            self.start()
        digest = hashlib.sha256(payload).hexdigest()
        if digest not in self.seen:
            image = encode_png(payload)
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(image)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.seen[digest] = (self.at + len(head), len(image))
            self.out.write(head + image + b"\0" * (-len(image) % 512))
            self.at += len(head) + len(image) + -len(image) % 512
            self.sum.update(digest.encode())
        self.rows.append((doc_id, n_bytes, digest, *self.seen[digest]))

    def finish(self) -> list[tuple]:
        """Close the shard; its index rows."""
        if self.out is None:
            return []
        self.out.write(b"\0" * 1024)
        self.out.close()
        shard = f"{self.sum.hexdigest()[:32]}.tar"
        self.fs.move(self.name, f"{self.root}/{shard}")
        self.out = None
        return [(i, n, d, shard, o, k) for i, n, d, o, k in self.rows]


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])


def store(docs: DataFrame, where: str) -> DataFrame:
    """Write all payloads to shards under ``where``; the index (a Parquet table there), one row per document."""
    fs_, root = _open(where)
    fs_.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(where)
        for b in batches:
            ids = b.column(0).to_pylist()
            for i, text in enumerate(b.column(1)):
                shards.add(ids[i], *padded(text.as_py()))
                if shards.at >= SHARD_BYTES:
                    yield _index_batch(shards.finish())
        if rows := shards.finish():
            yield _index_batch(rows)

    spark = docs.sparkSession
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, INDEX).write.parquet(f"{where}/index")
    for f in fs_.get_file_info(FileSelector(root)):  # one entry for each shard
        if f.base_name.startswith(".part-"):  # of an attempt that was lost
            fs_.delete_file(f.path)
    return spark.read.schema(INDEX).parquet(f"{where}/index")


def addresses(index: DataFrame) -> DataFrame:
    """(digest, shard, offset, length): one address for each digest."""
    return index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("a")).select("digest", "a.shard", "a.offset", "a.length")


def metadata(index: DataFrame, where: str) -> DataFrame:
    """(digest, width, height) of every stored image, from its header bytes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs_, root = _open(where)
        for b in batches:
            out, name, f = [], None, None
            for digest, shard, offset in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if shard != name:
                    name, f = shard, fs_.open_input_file(f"{root}/{shard}")
                out.append((digest, *read_header(f.read_at(HEADER, offset))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), *[pa.array([r[i] for r in out], pa.int32()) for i in (1, 2)]], ["digest", "width", "height"])

    return addresses(index).select("digest", "shard", "offset").mapInArrow(run, "digest string, width int, height int")


def read_back(index: DataFrame, where: str) -> DataFrame:
    """Features of every stored image, from its stored bytes; each image is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs_, root = _open(where)
        for b in batches:
            out, name, f = [], None, None
            for digest, shard, offset, length in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if shard != name:
                    name, f = shard, fs_.open_input_file(f"{root}/{shard}")
                width, height = read_header(f.read_at(HEADER, offset))
                image = f.read_at(length, offset)
                payload = decode_png(image)
                found = hashlib.sha256(payload).hexdigest()
                if found != digest:
                    raise ValueError(f"{shard}:{offset} holds {found}, not {digest}")
                spaces, lines = payload.count(b" "), payload.count(b"\n")
                out.append((digest, len(payload), found, zlib.crc32(payload[-16:]), length, hashlib.sha256(image).hexdigest(), width, height, f"png {width}x{height} gray8 mean={sum(payload) / len(payload):.3f} spaces={spaces} lines={lines}"))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            names = [x.split()[0] for x in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    # reads follow the shards' order; equal sizes by offset ranges, so one large shard is read by many tasks
    dealt = addresses(index).withColumn("run", F.shiftright("offset", 23)).repartition("shard", "run").sortWithinPartitions("shard", "offset")
    return dealt.select("digest", "shard", "offset", "length").mapInArrow(run, FEATURES)


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns, then shard, offset, width and height."""
    where = f"{shared_dir(docs.sparkSession).rstrip('/')}/media-{uuid.uuid4().hex}"
    index = store(docs, where)
    found = read_back(index, where).join(addresses(index).select(F.col("digest").alias("d"), "shard", "offset"), F.col("digest") == F.col("d")).drop("d")
    rows = index.select("doc_id", "n_bytes", F.col("digest").alias("d")).join(found, F.col("d") == F.col("digest"))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "width", "height")
