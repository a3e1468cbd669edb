"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 64 bits make 32 segments of two bits; the embedding is the
vector of their bit counts, and the Manhattan distance of two vectors is at
most the Hamming distance of the fingerprints. Bit counts 0, 1, 2 are written
as 00, 01, 11, so a vector is a 64-bit number of its own and Manhattan
distance is the number of differing bits. The join puts vectors into the cells
of a grid: at distance K or less, at least 8 - K of 8 groups of four
coordinates are equal, so every choice of 8 - K groups gives one grid, whose
cell is the coordinates in them. Pairs in a cell are held to the Manhattan
bound, then to the Hamming distance.

A cell never gives all its pairs: a search from the least unvisited member
gives edges of a spanning forest of the links in it, which has the same
components. Cells of more than CELL members are cut into chunks, and every
pair of chunks is searched by itself.

Defined cases: a null text, like one without words, has fingerprint zero, and
is linked like any other; fewer words than a shingle are one shingle; repeated
shingles count each time; equal fingerprints are one node, so copies need no
pairs; null ids lose to others as component id; an empty table gives an empty
result; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import LOWER, UPPER, cut, slices
from tracewright.llm.graph import components

SHINGLE, SEED, GROUPS = 4, 42, 8
#: Members of a cell, or chunk of one, that are searched together.
CELL = 8192


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if set in over half of the shingles' XXH64."""
    import xxhash

    words = (text or b"").translate(bytes.maketrans(UPPER.encode(), LOWER.encode())).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[:-shingle]])
    take, count = xxhash.xxh64_intdigest, len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for i in range(0, count, 8192):
        pairs = zip(begins[i : i + 8192].tolist(), (ends[shingle - 1 + i : shingle - 1 + i + 8192] - 1).tolist(), strict=False)
        h = np.array([take(line[a:b], SEED) for a, b in pairs], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    source = docs.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t"))
    return source.mapInArrow(run, f"doc_id {source.schema['d'].dataType.simpleString()}, fp long")


EVEN = 0x5555555555555555


def embedding(fp: F.Column) -> F.Column:
    """The bit counts of the 32 segments, each as 00, 01 or 11."""
    low, high = fp.bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _embed(fp: np.ndarray) -> np.ndarray:
    low, high = fp & np.uint64(EVEN), (fp >> np.uint64(1)) & np.uint64(EVEN)
    return (low | high) | ((low & high) << np.uint64(1))


def forest(fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges (of positions) of a spanning forest of the links between fp (sorted, distinct, uint64): pairs at most `most` bits apart."""
    vector, edges = _embed(fp), []
    left = np.arange(len(fp))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(vector[left] ^ vector[i]) <= most  # the Manhattan bound
            some = np.flatnonzero(near)
            some = some[np.bitwise_count(fp[left[some]] ^ fp[i]) <= most]
            if len(some):
                found = left[some]
                edges += [(i, j) for j in found]
                queue += found.tolist()
                left = np.delete(left, some)
    return edges


def links(fps: DataFrame, most: int = 4, cell: int = CELL) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints fps (column fp) whose components are those of all pairs at most `most` bits apart."""
    equal = GROUPS - most
    if equal < 1:
        raise ValueError(f"at most {GROUPS - 1} differing bits")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    choices, masks = list(combinations(range(GROUPS), equal)), []
    for chosen in choices:
        mask = sum(0xFF << (8 * g) for g in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    # a cell is known by a hash of its grid and coordinates: cells that meet by chance give pairs that fail the check
    grids = [F.xxhash64(F.lit(m), F.col("v").bitwiseAND(F.lit(m))) for m in masks]
    # a fingerprint has few bytes and many cells, so fingerprints are dealt out before cells are made of them
    vectors = fps.select("fp", embedding(F.col("fp")).alias("v")).repartition(n, "fp")
    keyed = vectors.select("fp", F.explode(F.array(*grids)).alias("cell"))
    # each group's coordinates in a large cell stand in more than `cell` vectors, and a group has at most 81
    at = [F.shiftrightunsigned("v", 8 * g).bitwiseAND(F.lit(255)) for g in range(GROUPS)]
    each = vectors.select(F.explode(F.array(*(F.struct(F.lit(g).alias("g"), x.alias("x")) for g, x in enumerate(at)))).alias("c"))
    common = each.groupBy("c").agg(F.count("*").alias("n")).filter(F.col("n") > cell).select("c.*").collect()
    often = [x.isin([r["x"] for r in common if r["g"] == g]) for g, x in enumerate(at)]
    marked = vectors.withColumns({f"often{g}": x for g, x in enumerate(often)})
    likely = F.array_compact(F.array(*(F.when(reduce(and_, (F.col(f"often{g}") for g in chosen)), h) for chosen, h in zip(choices, grids, strict=True))))
    counted = marked.select(F.explode(likely).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    large = cut(counted.filter(F.col("n") > cell).select("cell", F.ceil(F.col("n") / cell).cast("int").alias("chunks")), "large")
    spread = keyed
    if large.count():
        # large cells: member i goes with every pair of chunks that has its own
        at = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        units = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.xxhash64("cell", F.least(j, F.col("at")), F.greatest(j, F.col("at"))))
        split = keyed.join(large, "cell").withColumn("at", at).select("fp", F.explode(units).alias("cell"))
        spread = keyed.join(large, "cell", "left_anti").select("fp", "cell").unionByName(split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def search(cells: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            """All rows of whole cells, in order of cell."""
            firsts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            sizes = np.diff(np.append(firsts, len(cells)))
            a, b = [], []
            two = firsts[sizes == 2]
            x, y = fp[two], fp[two + 1]
            near = (np.bitwise_count(_embed(x) ^ _embed(y)) <= most) & (np.bitwise_count(x ^ y) <= most)
            a.append(x[near])
            b.append(y[near])
            for i, n in zip(firsts[sizes > 2], sizes[sizes > 2], strict=True):
                own = np.unique(fp[i : i + n])
                if e := forest(own, most):
                    e = np.array(e)
                    a.append(own[e[:, 0]])
                    b.append(own[e[:, 1]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(s).astype(np.int64)) for s in (a, b)], ["a", "b"])

        rest = (np.empty(0, np.int64), np.empty(0, np.uint64))
        for batch in batches:
            cells = np.concatenate([rest[0], batch.column(1).to_numpy()])
            fp = np.concatenate([rest[1], batch.column(0).to_numpy().astype(np.uint64)])
            if not len(cells):
                continue
            last = int(np.searchsorted(cells, cells[-1]))
            if last:
                yield search(cells[:last], fp[:last])
            rest = (cells[last:], fp[last:])
        if len(rest[0]):
            yield search(*rest)

    return spread.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, most: int = 4, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id of every row of docs."""
    rows = cut(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = cut(components(cut(links(fps, most), "links")), "components")
    roots = fps.join(found, fps.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(roots.join(least, "root").select(F.col("fp").alias("f"), "component_id"), "named")
    joined = rows.join(named, rows.fp == named.f)
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
