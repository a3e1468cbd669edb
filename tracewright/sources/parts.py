"""What data sources that write files of their own share: parts that count only once an index names them.

Every attempt of a task writes under the folder of its write. The driver's
commit puts one small index file in place, which names the parts of the tasks
that won; a reader sees those and no others, so a write is there whole or not at
all, also in stores without a rename. Abort, and commit for what lost attempts
left, delete under the folder of that write alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from tracewright.sources.files import opened

INDEX = "_index.json"


@dataclass
class Written(WriterCommitMessage):
    """Parts of a task: path below the table, and what the format says of it."""

    parts: list[tuple[str, dict]]


def index_of(path: str) -> dict[str, dict]:
    """Parts that count, in order of their names; none where nothing was committed."""
    filesystem, at = opened(path)
    if filesystem.get_file_info(f"{at}/{INDEX}").type.name != "File":
        return {}
    with filesystem.open_input_file(f"{at}/{INDEX}") as source:
        return dict(sorted(json.loads(source.read().decode())["parts"].items()))


class PartsWriter(DataSourceArrowWriter):
    """Writes batches through `make`, an object with add(batch) and close() -> parts, one for each task."""

    def __init__(self, path: str, overwrite: bool, make: Callable[[str, str], object]):
        self.path, self.overwrite, self.make, self.id = path, overwrite, make, f"w-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        maker = self.make(self.path, f"{self.id}/{uuid.uuid4().hex}")
        for batch in iterator:
            maker.add(batch)
        return Written(maker.close())

    def commit(self, messages: list[Written | None]) -> None:
        filesystem, at = opened(self.path)
        old = index_of(self.path)
        new = {name: told for m in messages if m is not None for name, told in m.parts}
        filesystem.create_dir(at, recursive=True)
        # beside, then over the old one: a local move and a put are each one step
        with filesystem.open_output_stream(f"{at}/_next-{self.id}", compression=None) as out:
            out.write(json.dumps({"parts": new if self.overwrite else old | new}).encode())
        filesystem.move(f"{at}/_next-{self.id}", f"{at}/{INDEX}")
        won = {name.split("/")[1] for name in new}
        self._delete(lambda attempt: attempt not in won, [self.id])
        if self.overwrite:
            self._delete(lambda attempt: True, {name.split("/")[0] for name in old} - {self.id})

    def abort(self, messages: list[Written | None]) -> None:
        self._delete(lambda attempt: True, [self.id])

    def _delete(self, lost: Callable[[str], bool], writes) -> None:
        from pyarrow import fs

        filesystem, at = opened(self.path)
        for write in writes:
            found = filesystem.get_file_info(fs.FileSelector(f"{at}/{write}", allow_not_found=True))
            gone = [f.path for f in found if lost(f.base_name)]
            for path in gone:
                filesystem.delete_dir(path)
            if len(gone) == len(found) and filesystem.get_file_info(f"{at}/{write}").type.name == "Directory":
                filesystem.delete_dir(f"{at}/{write}")
