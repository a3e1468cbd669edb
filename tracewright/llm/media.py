"""Media columns: content-addressed payloads in tar shards.

A text's UTF-8 bytes, with bytes 255 appended up to a positive multiple of
UNIT, are the 8-bit samples of a grey PNG image WIDTH samples wide (lossless).
Every task writes tar shards of its own into the shared folder; an entry is
named by the SHA-256 of the stored bytes, and a payload that a shard already
has isn't written again. A row carries digest, shard, offset and length, and of
equal payloads in several shards all rows point at the same one. Metadata
columns are filled from the first bytes of an entry alone, by a range read.

Defined cases: a null text is empty, and 576 bytes 255; equal texts have equal
values; repeated rows are kept; an empty table gives no shards and no rows;
extra columns aren't read. A task that is run again writes other shards, and
those of the lost attempt are never pointed at.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import cut, scratch, slices
from tracewright.sources.files import opened

UNIT, WIDTH, SHARD_BYTES = 576, 24, 256 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of a range read that hold the header: signature, and the IHDR chunk.
HEADER = 33


def payload(text: bytes) -> bytes:
    size = max(UNIT, -(-len(text) // UNIT) * UNIT)
    return text.ljust(size, b"\xff")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """A grey 8-bit image; every line has filter 0."""
    height = len(samples) // width
    lines = np.zeros((height, width + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(samples, np.uint8).reshape(height, width)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first HEADER bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">IIB", data[16:25])


def decode_png(data: bytes) -> bytes:
    """The samples of an image that encode_png wrote."""
    width, height, _ = png_header(data)
    at, packed = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a damaged chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("another filter than 0")
    return lines[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the mean step between neighbours in a line."""
    x = np.frombuffer(samples, np.uint8)
    n = np.bincount(x, minlength=256)
    p, v = n / len(x), np.arange(256)
    mean = float(p @ v)
    deviation = float(p @ (v - mean) ** 2) ** 0.5
    some = p[p > 0]
    steps = np.abs(np.diff(x.reshape(-1, WIDTH).astype(np.int16), axis=1))
    return f"mean={mean:.4f};std={deviation:.4f};entropy={float(-(some * np.log2(some)).sum()):.4f};step={float(steps.mean()):.4f}"


def tar_header(name: str, size: int) -> bytes:
    """A ustar header block of a file."""
    head = bytearray(512)
    head[: len(name)] = name.encode()
    for at, what in ((100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size), (136, b"%011o\0" % 0), (148, b" " * 8), (156, b"0"), (257, b"ustar\00000")):
        head[at : at + len(what)] = what
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


class ShardWriter:
    """Tar shards of one task; add() gives shard, offset and length of the stored bytes."""

    def __init__(self, folder: str, shard_bytes: int = SHARD_BYTES):
        self.folder, self.most, self.out, self.has = folder, shard_bytes, None, {}
        self.fs, self.path = opened(folder)
        self.fs.create_dir(self.path, recursive=True)

    def add(self, key: bytes, data: bytes) -> tuple[str, int, int]:
        if key in self.has:
            return self.has[key]
        if self.out is not None and self.at + len(data) > self.most:
            self.close()
        if self.out is None:
            self.shard, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.path}/{self.shard}")
        self.out.write(tar_header(f"{key.hex()}.png", len(data)))
        self.out.write(data.ljust(-(-len(data) // 512) * 512, b"\0"))
        self.has[key] = (self.shard, self.at + 512, len(data))
        self.at += 512 + -(-len(data) // 512) * 512
        return self.has[key]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
        self.out, self.has = None, {}


def store(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index, as a table: doc_id, n_bytes, payload_bytes, digest (of the stored bytes), shard, offset and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in slices(batches):
            writer = writer or ShardWriter(folder)
            sizes, wholes, digests, at = [], [], [], []
            for text_ in batch.column(1).cast(pa.binary()).to_pylist():
                data = payload(text_ or b"")
                image = encode_png(data)
                key = hashlib.sha256(image).digest()
                sizes.append(len(text_ or b""))
                wholes.append(len(data))
                digests.append(key)
                at.append(writer.add(key, image))
            shard, offset, length = zip(*at, strict=True) if at else ((), (), ())
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), long(sizes), long(wholes), pa.array(digests, pa.binary()), pa.array(shard, pa.string()), long(offset), long(length)], ["doc_id", "n_bytes", "payload_bytes", "digest", "shard", "offset", "length"])
        if writer:
            writer.close()

    source = docs.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t"))
    kind = source.schema["d"].dataType.simpleString()
    return cut(source.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, digest binary, shard string, offset long, length long"), "media-index")


def compacted(index: DataFrame) -> DataFrame:
    """One row for each digest: of its places the first."""
    return index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place")).select("digest", "place.*")


def metadata(places: DataFrame, folder: str) -> DataFrame:
    """Places with width, height and bits, by range reads of the headers alone. Rows stay where they are."""
    return _read(places, folder, HEADER, "width long, height long, bits long", png_header)


def contents(places: DataFrame, folder: str) -> DataFrame:
    """Places with what is computed from the stored bytes as read back; a stored form other than its digest is an error. Rows stay where they are."""

    def values(data: bytes) -> tuple:
        samples = decode_png(data)
        return hashlib.sha256(data).digest(), hashlib.sha256(samples).digest(), zlib.crc32(samples[-32:]), features(samples)

    return _read(places, folder, None, "stored_digest binary, payload_digest binary, tail_crc32 long, feature string", values)


def dealt(places: DataFrame) -> DataFrame:
    """Places in the order of their shards, so that each task reads runs of them."""
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return places.repartitionByRange(n, "shard", "offset").sortWithinPartitions("shard", "offset")


def _read(places: DataFrame, folder: str, most: int | None, schema: str, values) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = opened(folder)
        shard, source = None, None
        for batch in slices(batches):
            out = []
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if name != shard:
                    if source is not None:
                        source.close()
                    shard, source = name, filesystem.open_input_file(f"{path}/{name}")
                out.append(values(source.read_at(length if most is None else min(most, length), offset)))
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [*batch.schema.names, *names])
        if source is not None:
            source.close()

    made = T.StructType(list(places.schema.fields))
    for name, kind in zip(names, schema.split(", "), strict=True):
        made = made.add(name, kind.split()[1])
    return places.mapInArrow(run, made)


def media(docs: DataFrame, folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores every text of docs and returns its row with place, metadata (of the headers) and what was read back (of the bodies)."""
    folder = folder or scratch(docs.sparkSession, "shards")
    index = store(docs, folder, doc_id, text)
    places = dealt(cut(compacted(index), "media-places"))
    found = cut(contents(metadata(places, folder), folder), "media-contents")
    wrong = F.raise_error(F.concat(F.lit("stored bytes are not those of "), F.hex("digest")))
    found = found.withColumn("digest", F.when(F.col("stored_digest") == F.col("digest"), F.col("digest")).otherwise(wrong)).drop("stored_digest")
    text_of = lambda c, out: F.lower(F.hex(c)).alias(out)
    rows = index.drop("shard", "offset", "length").join(found, "digest")
    return rows.select("doc_id", "n_bytes", "payload_bytes", text_of("payload_digest", "payload_sha256"), "tail_crc32", F.col("length").alias("media_bytes"), text_of("digest", "media_sha256"), "feature", "width", "height", "bits", "shard", "offset", "length")
