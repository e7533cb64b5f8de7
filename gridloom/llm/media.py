"""Media columns: content-addressed payloads in tar shards.

Texts become 8-bit greyscale PNG images of 192 pixels a row. Each task packs its images into tar shards in the shared
folder, one member per distinct payload it meets, named by the payload's SHA-256; rows carry digest, shard, offset and
length. A grouped minimum then names one canonical member per digest, which all rows of that content use; members that
lost are unreferenced. A pass of range reads of 33 bytes fills the metadata columns; another reads whole members for the features.

A shard's name is unique to the task attempt that wrote it, and the table of locations is committed by Spark, so rows
refer to shards of successful attempts only. No exchange carries payloads.

Defined results: a null text is an empty one, whose payload is one row of blanks; equal texts, equal values; every input
row gives one output row, repeated rows and ids too; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROW = 192
SHARD_BYTES = 256 << 20
HEADER_BYTES = 33
LEVEL = 6
READ_BYTES = 64 << 20
PNG = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with blanks to a positive multiple of ``ROW``, and the unpadded length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % ROW if raw else ROW), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes) -> bytes:
    """A PNG image that holds ``payload`` as its samples; the same bytes for the same payload."""
    height = len(payload) // ROW
    rows = np.zeros((height, ROW + 1), np.uint8)  # each row starts with filter type 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    head = struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int, int]:
    """(width, height, bits, colour type) from the first 33 bytes."""
    if first[:8] != PNG or first[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", first[16:26])


def decode(media: bytes) -> bytes:
    """The samples of an image made by ``encode``; checks the chunks' checksums."""
    width, height, bits, colour = header(media)
    if (bits, colour) != (8, 0):
        raise ValueError("not an 8-bit greyscale image")
    at, data = 8, []
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("unexpected row filter")
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, entropy, share of equal neighbours and an eight-bin histogram of the samples."""
    x = np.frombuffer(samples, np.uint8)
    count = np.bincount(x, minlength=256)
    p = count[count > 0] / len(x)
    still = float((x[1:] == x[:-1]).mean())
    bins = "".join(f"{int(v):02x}" for v in np.minimum(count.reshape(8, 32).sum(axis=1) * 255 // len(x), 255))
    return f"mean={x.mean():.4f};entropy={-(p * np.log2(p)).sum():.4f};still={still:.4f};hist={bins}"


class _Shards:
    """Appends members to tar shards below a folder of the shared store, and tells where each lies."""

    def __init__(self, folder: str, name: str, limit: int) -> None:
        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.root, recursive=True)
        self.prefix, self.limit, self.file, self.at, self.n = name, limit, None, 0, 0

    def add(self, name: str, data: bytes) -> tuple[str, int, int]:
        if self.file is None or self.at > self.limit:
            self.close()
            self.shard = f"{self.prefix}-{self.n:04d}.tar"
            self.file, self.at, self.n = self.store.open_output_stream(f"{self.root}/{self.shard}"), 0, self.n + 1
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.file.write(head + data + b"\0" * (-len(data) % 512))
        start = self.at + len(head)
        self.at = start + len(data) + (-len(data) % 512)
        return self.shard, start, len(data)

    def close(self) -> None:
        if self.file is not None:
            self.file.write(b"\0" * 1024)  # end of archive
            self.file.close()
            self.file = None


def store(docs: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write shards below ``folder`` and return (doc_id, n_bytes, digest, shard, offset, length) as a table."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    place = f"{folder}/shards"
    kind = rows.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shards = _Shards(place, f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", shard_bytes)
        known: dict[bytes, tuple[str, int, int]] = {}
        for b in batches:
            found = []
            for t in b.column(1):
                payload, n = payload_of(t.as_py())
                digest = hashlib.sha256(payload).digest()
                if digest not in known:
                    known[digest] = shards.add(f"{digest.hex()}.png", encode(payload))
                found.append((n, digest, *known[digest]))
            cols = list(zip(*found, strict=True)) if found else [()] * 5
            kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]],
                ["doc_id", "n_bytes", "digest", "shard", "offset", "length"],
            )
        shards.close()

    out = rows.mapInArrow(pack, f"doc_id {kind}, n_bytes long, digest binary, shard string, offset long, length long")
    return common.table(out, f"{folder}/rows")


def canonical(rows: DataFrame, folder: str) -> DataFrame:
    """One location for each digest, as a table."""
    first = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("x"))
    return common.table(first.select("digest", "x.*"), f"{folder}/objects")


def _ranges(objects: DataFrame) -> DataFrame:
    """Objects dealt out in the order in which they lie in the shards, so that each task reads a stretch of each."""
    total = objects.agg(F.sum("length").alias("n")).first().n or 0
    n = max(int(objects.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // READ_BYTES))
    return objects.repartitionByRange(n, "shard", "offset").sortWithinPartitions("shard", "offset")


def _reader(folder: str, work, names: list[str], kinds: list):
    """A map over (digest, shard, offset, length) that calls work(read, length) with a range reader of the member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store_, root = fs.FileSystem.from_uri(folder)
        name, file = None, None
        for b in batches:
            found = []
            for shard, offset, length in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, store_.open_input_file(f"{root}/{shard}")

                def read(n: int, offset: int = offset) -> bytes:
                    file.seek(offset)
                    return file.read(n)

                found.append(work(read, length))
            cols = list(zip(*found, strict=True)) if found else [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]], ["digest", *names])

    return run


def metadata(objects: DataFrame, folder: str) -> DataFrame:
    """(digest, width, height, bits) by header-only range reads: 33 bytes of each object, however large it is."""

    def work(read, length: int) -> tuple:
        return header(read(HEADER_BYTES))[:3]

    run = _reader(f"{folder}/shards", work, ["width", "height", "bits"], [pa.int64(), pa.int64(), pa.int32()])
    return _ranges(objects).mapInArrow(run, "digest binary, width long, height long, bits int")


def features(objects: DataFrame, folder: str) -> DataFrame:
    """What the stored bytes of each object hold."""

    def work(read, length: int) -> tuple:
        media = read(length)
        samples = decode(media)
        return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = "digest binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _ranges(objects).mapInArrow(_reader(f"{folder}/shards", work, names, kinds), schema)


def report(docs: DataFrame, folder: str) -> DataFrame:
    """Metadata columns by the header-only pass, features by the pass over whole members, for every row of ``docs``."""
    rows = store(docs, folder)
    objects = canonical(rows, folder)
    heads = common.table(metadata(objects, folder), f"{folder}/heads")
    found = common.table(features(objects, folder).join(heads, "digest"), f"{folder}/features")
    out = rows.select("doc_id", "n_bytes", "digest").join(found, "digest")
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits"
    )
