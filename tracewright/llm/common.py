"""What the operators share: the shared folder, lineage cuts, ranks by pieces, ASCII case."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.operators.ranges import running
from tracewright.sources.files import materialised as cut
from tracewright.sources.files import scratch

__all__ = ["LOWER", "UPPER", "ascii_lower", "cut", "running", "scratch", "slices"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lowered and nothing else; lower() does the same, faster, where a text is all ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of at most `rows` rows, so that what is made of texts is held for some at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
