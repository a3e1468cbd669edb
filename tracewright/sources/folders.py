"""A folder for each row, a text file for each of its columns, as a sink whose writes are there whole or not at all.

Defined cases: a file is its text and a line break; a null value is an empty text; folder names are any text without
a slash (else an error), null being an error too; rows that share a folder name
in one write are an error where one task sees both, and lie in different parts
otherwise, both being read; an empty table leaves a table without rows; a file
that isn't there reads as null.

The folders of a part lie in BUCKETS folders by their names, so that readers list
some of them each: neither their names nor those of their files come to the
driver, which has one line of the index for each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracewright.sources.files import opened
from tracewright.sources.parts import PartsWriter, index_of

#: Folders that a part deals its rows' folders to, rows of a split of a part, and rows of a batch.
BUCKETS, SPLIT_ROWS, BATCH_ROWS = 256, 10_000, 1000


@dataclass
class Split(InputPartition):
    """Some of the buckets of a part."""

    part: str
    buckets: list[int]


class FolderReader(DataSourceReader):
    """Rows of the parts that count, each split listed and read in its task."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def partitions(self) -> list[Split]:
        every = range(BUCKETS)
        return [Split(part, list(every[k::n])) for part, told in index_of(self.path).items() for n in [min(BUCKETS, -(-told["rows"] // SPLIT_ROWS))] for k in range(n)] or [Split("", [])]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        filesystem, at = opened(self.path)

        def text(folder: str, name: str) -> str | None:
            try:
                with filesystem.open_input_stream(f"{folder}/{name}.txt", compression=None) as source:
                    return source.read().decode().removesuffix("\n")
            except FileNotFoundError:
                return None

        for bucket in partition.buckets:
            found = filesystem.get_file_info(fs.FileSelector(f"{at}/{partition.part}/{bucket:02x}", allow_not_found=True))
            for k in range(0, len(found), BATCH_ROWS):
                some = found[k : k + BATCH_ROWS]
                columns = [[f.base_name for f in some], *([text(f.path, name) for f in some] for name in self.names)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["folder", *self.names])


class Folders:
    """Folders of one task; the first column names the folder."""

    def __init__(self, path: str, part: str, names: list[str]):
        self.part, self.names, self.rows = part, names, 0
        self.fs, self.at = opened(path)

    def add(self, batch: pa.RecordBatch) -> None:
        for folder, *texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not folder or "/" in folder or folder in (".", ".."):
                raise ValueError(f"{folder!r} can't name a folder")
            at = f"{self.at}/{self.part}/{crc32(folder.encode()) % BUCKETS:02x}/{folder}"
            if self.fs.get_file_info(at).type.name != "NotFound":
                raise ValueError(f"two rows have the folder {folder!r}")
            self.fs.create_dir(at, recursive=True)
            for name, text in zip(self.names, texts, strict=True):
                with self.fs.open_output_stream(f"{at}/{name}.txt", compression=None) as out:
                    out.write(f"{text or ''}\n".encode())
            self.rows += 1

    def close(self) -> list[tuple[str, dict]]:
        return [(self.part, {"rows": self.rows})] if self.rows else []


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folders"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"], schema.fieldNames()[1:])

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        names = schema.fieldNames()[1:]
        return PartsWriter(self.options["path"], overwrite, lambda path, part: Folders(path, part, names))


def write_folder_rows(df: DataFrame, path: str, folder: str, mode: str = "append") -> None:
    """A folder for each row, a text file for each other column; rows of a folder name go to one task."""
    df.sparkSession.dataSource.register(FolderSource)
    rows = df.select(F.col(folder).cast("string").alias(folder), *(F.col(c).cast("string").alias(c) for c in df.columns if c != folder))
    rows.repartition(folder).write.format("folders").option("path", path).mode(mode).save()


def read_folder_rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """folder and the text of each named file in it, of the parts that count."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("folders").schema(", ".join(f"`{c}` string" for c in ("folder", *names))).option("path", path).load()
