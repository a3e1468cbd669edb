"""Tensor files as a source and a sink: a length, a JSON header of names, kinds, shapes and offsets, then raw little-endian numbers.

`spark.read.format("tensors")` gives a row for each line of each tensor (its
first axis): file, name, shape, row and values. A split is a range of lines of
one tensor, found from the header alone, so a tensor of any size is read by many
tasks and no task reads more than split_bytes at a time. `names` (an option, a
comma-separated list) leaves other tensors unread.

`write` takes rows (name, row, values). A tensor lies whole in one file, as the
format has it, so its lines go to one task; a task holds one file's tensors, at
most shard_bytes and a tensor. Files count once the write is committed.

Defined cases: an empty table is a table without tensors; lines of a tensor are
ordered by row; lines of different lengths, two lines of one number and null
values are errors, which leave nothing behind; names are any text but null.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracewright.sources.files import opened
from tracewright.sources.parts import PartsWriter, index_of

#: Kinds of numbers by their names in a header (fixed values of the format).
KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "<i1", "U8": "<u1"}
SCHEMA = "file string, name string, shape array<long>, row long, values array<double>"
SPLIT_BYTES, SHARD_BYTES, LINES = 64 << 20, 256 << 20, 256


def pack(tensors: dict[str, np.ndarray], kind: str = "F32") -> bytes:
    header, at, body = {}, 0, []
    for name, t in sorted(tensors.items()):
        raw = np.ascontiguousarray(t, KINDS[kind]).tobytes()
        header[name] = {"dtype": kind, "shape": list(t.shape), "data_offsets": [at, at + len(raw)]}
        at += len(raw)
        body.append(raw)
    head = json.dumps(header).encode()
    head += b" " * (-len(head) % 8)
    return struct.pack("<Q", len(head)) + head + b"".join(body)


def read_header(source) -> tuple[dict, int]:
    """Header of an open file and where its numbers begin; two small range reads."""
    size = struct.unpack("<Q", source.read_at(8, 0))[0]
    return json.loads(source.read_at(size, 8)), 8 + size


@dataclass
class Lines(InputPartition):
    """Lines from start to end of a tensor: offset is the byte of the first, width the numbers of a line."""

    file: str
    name: str
    kind: str
    shape: list[int]
    start: int
    end: int
    offset: int
    width: int


class TensorReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, names: set[str] | None):
        self.path, self.split_bytes, self.names = path, split_bytes, names

    def partitions(self) -> list[Lines]:
        files = list(index_of(self.path))
        with ThreadPoolExecutor(32) as pool:
            found = list(pool.map(self._lines_of, files))
        # a scan has a split at least
        return [x for one in found for x in one] or [Lines("", "", "F32", [], 0, 0, 0, 0)]

    def _lines_of(self, file: str) -> list[Lines]:
        filesystem, at = opened(self.path)
        with filesystem.open_input_file(f"{at}/{file}") as source:
            header, base = read_header(source)
        out = []
        for name, t in header.items():
            if name == "__metadata__" or (self.names is not None and name not in self.names):
                continue
            shape = t["shape"]
            lines = shape[0] if shape else 1
            width = int(np.prod(shape[1:], dtype=np.int64))
            size = np.dtype(KINDS[t["dtype"]]).itemsize * width
            step = max(1, self.split_bytes // max(1, size))
            out += [Lines(file, name, t["dtype"], shape, a, min(lines, a + step), base + t["data_offsets"][0] + a * size, width) for a in range(0, lines, step)]
        return out

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        p = partition
        if p.end == p.start:
            return
        filesystem, at = opened(self.path)
        kind = np.dtype(KINDS[p.kind])
        with filesystem.open_input_file(f"{at}/{p.file}") as source:
            for a in range(p.start, p.end, LINES):
                n = min(LINES, p.end - a)
                raw = source.read_at(n * p.width * kind.itemsize, p.offset + (a - p.start) * p.width * kind.itemsize)
                values = np.frombuffer(raw, kind).astype(np.float64)
                if len(values) != n * p.width:
                    raise ValueError(f"{p.file} ends within {p.name}")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * p.width, pa.int32()), pa.array(values))
                same = lambda x, t, n=n: pa.array([x] * n, t)
                yield pa.RecordBatch.from_arrays([same(p.file, pa.string()), same(p.name, pa.string()), same(p.shape, pa.list_(pa.int64())), pa.array(range(a, a + n), pa.int64()), lists], ["file", "name", "shape", "row", "values"])


class Shards:
    """Files of one task. Lines come by name and row; a file holds whole tensors."""

    def __init__(self, path: str, part: str, kind: str, most: int):
        self.path, self.part, self.kind, self.most = path, part, kind, most
        self.held: dict[str, np.ndarray] = {}
        self.now, self.lines, self.rows, self.parts, self.bytes = None, [], [], [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        for name, row, values in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if name is None or values is None or None in values:
                raise ValueError("a tensor's name and values can't be null")
            if name != self.now:
                self._end()
                self.now = name
            self.rows.append(row)
            self.lines.append(np.asarray(values, KINDS[self.kind]))

    def _end(self) -> None:
        if self.now is None:
            return
        if len(set(self.rows)) != len(self.rows) or len({len(x) for x in self.lines}) != 1:
            raise ValueError(f"lines of tensor {self.now} are repeated or of different lengths")
        whole = np.stack(self.lines)
        if self.held and self.bytes + whole.nbytes > self.most:
            self._flush()
        self.held[self.now] = whole
        self.bytes += whole.nbytes
        self.lines, self.rows = [], []

    def _flush(self) -> None:
        if self.held:
            filesystem, at = opened(self.path)
            filesystem.create_dir(f"{at}/{self.part}", recursive=True)
            name = f"{self.part}/{len(self.parts):05d}.tensors"
            with filesystem.open_output_stream(f"{at}/{name}", compression=None) as out:
                out.write(pack(self.held, self.kind))
            self.parts.append((name, {"tensors": len(self.held), "bytes": self.bytes}))
            self.held, self.bytes = {}, 0

    def close(self) -> list[tuple[str, dict]]:
        self._end()
        self._flush()
        return self.parts


class TensorSource(DataSource):
    """Options: path, split_bytes, shard_bytes, names, dtype (of what is written)."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TensorReader:
        names = self.options.get("names")
        return TensorReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)), None if names is None else set(names.split(",")))

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        kind, most = self.options.get("dtype", "F32"), int(self.options.get("shard_bytes", SHARD_BYTES))
        return PartsWriter(self.options["path"], overwrite, lambda path, part: Shards(path, part, kind, most))


def write(df: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    """df (name, row, values) as tensor files under path; mode is append or overwrite."""
    df.sparkSession.dataSource.register(TensorSource)
    rows = df.select("name", F.col("row").cast("long").alias("row"), F.col("values").cast("array<double>").alias("values"))
    rows.repartition("name").sortWithinPartitions("name", "row").write.format("tensors").options(**options).option("path", path).mode(mode).save()


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Lines of the tensors that were written to path."""
    spark.dataSource.register(TensorSource)
    return spark.read.format("tensors").options(**options).option("path", path).load()
