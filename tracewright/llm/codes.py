"""Product codes of vectors: each of `parts` equal parts of a vector becomes the number of its nearest codebook entry.

Vectors are made integers (floor of scale * x), so that sums, distances and
ties are the same on every machine and in every order of addition. They are
written once as blocks: a block holds some thousand vectors column by column,
one numpy line for each dimension. A round is an RDD treeAggregate over the
blocks: distances to the entries of a part accumulate dimension by dimension,
np.add.at adds each part to the sums and counts of its entry, and the tensors
(parts x entries x dimensions, and counts) of the tasks are added along a
reduction tree. What reaches the driver in a round is one such tensor.

Defined cases: a row whose vector is null or holds a null, NaN or infinite
component is dropped. The length of vectors is that of the longest kept one,
rounded up to a multiple of `parts`; shorter ones end in zeros. The codebooks
start with the rows of the smallest ids, null ids last and rows of equal id by
their vectors; of fewer rows than entries there are as many entries as rows.
Rows that share an id, or are repeated, count each. Values whose squares or
sums leave 64 bits are reckoned in whole numbers of any size; an error that a
long can't hold is null. An empty table gives an empty result. Columns other
than id, vector and label aren't read.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import cut

#: Components of a block (4,096 vectors of 64); depth of the reduction tree.
BLOCK, DEPTH = 1 << 18, 3
#: Labels whose errors are broadcast; with more, rows of a label are met in SALT places.
BROADCAST, SALT = 100_000, 32
LONG = 2**63 - 1


def whole(x: float, scale: int) -> int:
    """floor(scale * x), also where that product isn't a finite double. scale is a power of two, so the product is exact below."""
    return int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale)


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in the narrowest integers that hold them, or as Python's own beyond 62 bits."""
    if values.size and np.abs(values).max() * scale >= 2.0**62:
        return np.array([whole(float(x), scale) for x in values.ravel()], dtype=object).reshape(values.shape)
    found = np.floor(values * scale).astype(np.int64)
    most = int(np.abs(found).max()) if found.size else 0
    return found.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def packed(x: np.ndarray) -> bytes:
    """Bytes of a block. Whole numbers of any size are told by a first byte of their own."""
    return b"o" + pickle.dumps(x.tolist()) if x.dtype == object else x.dtype.char.encode() + np.ascontiguousarray(x).tobytes()


def unpacked(data: bytes, dims: int, rows: int, kind: type) -> np.ndarray:
    """The (dims, rows) array of a block, as `kind`."""
    if data[:1] == b"o":
        return np.array(pickle.loads(data[1:]), dtype=object).reshape(dims, rows)
    return np.frombuffer(data, np.dtype(chr(data[0])), offset=1).reshape(dims, rows).astype(kind)


def kept_vectors(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(id, label, x) of the rows that count, x as doubles."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    return rows.filter(F.col("x").isNotNull() & F.forall("x", fine))


def written_blocks(kept: DataFrame, dims: int, scale: int) -> DataFrame:
    """A table of blocks: ids and labels of the rows, their integers by dimension, and the largest of them without sign (as text, it may exceed a long)."""
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    most_rows = max(1, BLOCK // max(1, dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most_rows):
                part = batch.slice(at, most_rows)
                lists = part.column(2)
                lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.intp)
                values = np.zeros((part.num_rows, dims))
                values[np.arange(dims) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
                x = integers(values.T, scale)
                most = max((abs(int(v)) for v in (x.max(), x.min())), default=0) if x.size else 0
                one = lambda col: pa.ListArray.from_arrays(pa.array([0, len(col)], pa.int32()), col)
                yield pa.RecordBatch.from_arrays([one(part.column(0)), one(part.column(1)), pa.array([packed(x)], pa.binary()), pa.array([str(most)])], ["ids", "labels", "x", "most"])

    return cut(kept.mapInArrow(run, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, x binary, most string"), "blocks")


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each column of x (dims, rows), of a book (entries, dims): distances accumulate dimension by dimension, ties go to the lower entry."""
    far = np.zeros((len(book), x.shape[1]), dtype=book.dtype)
    for d in range(len(x)):
        step = x[d][None, :] - book[:, d][:, None]
        far += step * step
    found = far.argmin(axis=0)
    return found, far[found, np.arange(x.shape[1])]


def tallied(total: tuple | None, x: np.ndarray, books: np.ndarray) -> tuple:
    """total (sums, counts) with a block added; books are (parts, entries, width)."""
    parts, entries, width = books.shape
    sums, counts = total or (np.zeros(books.shape, books.dtype), np.zeros((parts, entries), np.int64))
    for p in range(parts):
        piece = x[p * width : (p + 1) * width]
        found, _ = nearest(piece, books[p])
        np.add.at(sums[p], found, piece.T)
        np.add.at(counts[p], found, 1)
    return sums, counts


def added(a: tuple | None, b: tuple | None) -> tuple | None:
    """Sums and counts of two tasks; None where a task had no block."""
    return a or b if a is None or b is None else (a[0] + b[0], a[1] + b[1])


def moved(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entries at the floor of their parts' means; unused ones stay."""
    n = counts[:, :, None]
    return np.where(n > 0, sums // np.maximum(n, 1), books)


def first_books(kept: DataFrame, dims: int, parts: int, entries: int, scale: int) -> np.ndarray:
    """Codebooks (parts, entries, width) of the rows of the smallest ids."""
    rows = kept.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    values = np.zeros((len(rows), dims))
    for i, row in enumerate(rows):
        values[i, : len(row["x"])] = row["x"]
    return integers(values, scale).reshape(len(rows), parts, dims // parts).transpose(1, 0, 2)


def fit(blocks: RDD, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks after so many rounds over an RDD of (rows, bytes) of blocks. A lost task reads its blocks again from the table."""
    dims, kind = books.shape[0] * books.shape[2], books.dtype.type
    for _ in range(rounds):
        sent = blocks.context.broadcast(books)
        read = lambda total, block, sent=sent: tallied(total, unpacked(block[1], dims, block[0], kind), sent.value)
        total = blocks.treeAggregate(None, read, added, DEPTH)
        if total is not None:
            books = moved(books, *total)
    return books


def assigned(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code (two hex digits a part) and error of every row."""
    parts, _, width = books.shape
    kinds = [blocks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels")]
    digits = [f"{i:02x}" for i in range(256)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = unpacked(batch.column(2)[i].as_py(), parts * width, len(batch.column(0)[i].values), books.dtype.type)
                found = [nearest(x[p * width : (p + 1) * width], books[p]) for p in range(parts)]
                error = sum(far for _, far in found)
                codes = ["".join(digits[e] for e in row) for row in np.stack([e for e, _ in found], axis=1).tolist()]
                errors = pa.array([int(e) if int(e) <= LONG else None for e in error.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(codes, pa.string()), errors], ["id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"id {kinds[0]}, label {kinds[1]}, code string, error long")


def by_label(rows: DataFrame) -> DataFrame:
    """rows with label_error: the sum of error over the rows of equal label, null labels together. Sums are made before anything is dealt out, so a label with a third of all rows is small."""
    whole_sum = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = cut(rows.groupBy(F.col("label").alias("__label")).agg(F.when((whole_sum <= LONG) & (F.count("error") == F.count("*")), whole_sum).cast("long").alias("label_error")), "label-errors")
    if sums.count() <= BROADCAST:
        return rows.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("__label")), "left").drop("__label")
    spread = sums.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = rows.withColumn("__at", F.pmod(F.xxhash64("id", "code"), F.lit(SALT)).cast("int"))
    return salted.join(spread, F.col("label").eqNullSafe(F.col("__label")) & (F.col("__at") == F.col("__salt")), "left").drop("__label", "__salt", "__at")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal digits, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, code, error, label_error of every kept row; the codebooks). scale is a power of two, entries at most 256."""
    if scale <= 0 or scale & (scale - 1) or not 0 < entries <= 256:
        raise ValueError("scale has to be a power of two, and entries at most 256")
    kept = kept_vectors(vectors, vec_id, vector, label)
    longest = kept.agg(F.max(F.size("x"))).first()[0] or 0
    dims = -(-longest // parts) * parts
    books = first_books(kept, dims, parts, entries, scale)
    if not books.shape[1]:
        none = kept.select(F.col("id").alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none.limit(0), books
    blocks = written_blocks(kept, dims, scale)
    size = blocks.agg(F.max(F.col("most").try_cast("decimal(38,0)")).alias("near"), F.max(F.length("most")).alias("digits"), F.sum(F.size("ids")).alias("rows")).first()
    most = int(size["near"]) if size["digits"] <= 38 else 10 ** size["digits"]
    fits = dims * (2 * most) ** 2 <= LONG and size["rows"] * most <= LONG
    books = books.astype(np.int64 if fits else object)
    books = fit(blocks.select(F.size("ids"), "x").rdd.map(lambda row: (row[0], bytes(row[1]))), books, rounds)
    rows = by_label(cut(assigned(blocks, books), "codes"))
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error"), books
