"""Near copies by word shingles: texts whose shingle sets have a Jaccard similarity of LEAST or more.

Candidates come from MinHash bands: ROWS minima of a band agree with
probability s ** ROWS at similarity s, so that of BANDS bands at least one does
with 1 - (1 - s ** ROWS) ** BANDS, which is 0.9996 at 0.8 and more above. (A
SimHash radius as wide as 0.8 needs, ten bits on average and up to seventeen in
short texts, leaves no group of bits that is equal and selective.) Cells from
elsewhere, such as the pipeline's SimHash components, may be added. Texts of a
cell are then held to the similarity of their whole shingle sets.

A cell never gives all its pairs: a search from the least unvisited member
gives edges of a spanning forest of the links in it, which has the same
components. Texts that share cells, over others too, make a cluster, which is
searched at once where it has at most CELL texts; of larger clusters each cell
is searched by itself, and cells of more than CELL members are cut into chunks,
every pair of which is searched. Only texts that share a cell are read again.

Defined cases: A-Z is lowered and words end at ASCII white space; a null text
is empty; texts without words are near copies of each other; fewer words than a
shingle are one shingle; a shingle counts once, and is known by its XXH64; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import LOWER, UPPER, cut, slices
from tracewright.llm.dedup import digest_filter, filter_bits, normalised, probed
from tracewright.llm.graph import components

SHINGLE, LEAST, SEED, BANDS, ROWS = 5, 0.8, 42, 20, 5
#: Members of a cluster, cell or chunk that are searched together; texts that share cells, broadcast by key at most.
CELL, BROADCAST = 2048, 100_000

_draw = np.random.default_rng(SEED)
FACTORS, SHIFTS, MIX = (_draw.integers(0, 1 << 64, n, np.uint64) | np.uint64(1) for n in (BANDS * ROWS, BANDS * ROWS, BANDS * ROWS))


def text_key(text: Column) -> Column:
    """Texts of the same bytes, after A-Z is lowered, are one node."""
    return F.xxhash64(normalised(text))


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the distinct shingles, in order."""
    import xxhash

    words = (text or b"").translate(bytes.maketrans(UPPER.encode(), LOWER.encode())).split()
    take, line = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return np.array([take(line, SEED)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    pairs = zip([0, *ends[:-shingle].tolist()], (ends[shingle - 1 :] - 1).tolist(), strict=True)
    return np.unique(np.fromiter((take(line[a:b], SEED) for a, b in pairs), np.uint64, len(words) - shingle + 1))


def bands(found: np.ndarray) -> np.ndarray:
    """One number for each band, of its place and its minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 512):
        least = np.minimum(least, (found[i : i + 512, None] * FACTORS + SHIFTS).min(0))
    # upper bits go down, since a product's lower bits see lower bits alone
    return (((least ^ least >> np.uint64(32)) * MIX).reshape(BANDS, ROWS)).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)


def forest(keys: list[int], sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between keys: pairs whose sets have a Jaccard similarity of at least `least`."""
    keys, first = np.unique(np.array(keys, np.int64), return_index=True)
    sets = [sets[i] for i in first]
    size = np.array([len(s) for s in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    parts = np.split(ids, np.cumsum(size)[:-1])
    marks, edges = np.zeros(len(ids) + 1, bool), []
    left = np.arange(len(keys))
    flat, owner = ids, np.repeat(left, size)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            marks[parts[i]] = True
            common = np.bincount(owner[marks[flat]], minlength=len(keys))[left]
            marks[parts[i]] = False
            near = common >= least * (size[left] + size[i] - common) - 1e-9
            if near.any():
                found = left[near]
                edges += [(int(keys[i]), int(keys[j])) for j in found]
                queue += found.tolist()
                left = left[~near]
                stay = np.isin(owner, left)
                flat, owner = flat[stay], owner[stay]
    return edges


def links(docs: DataFrame, least: float = LEAST, cell: int = CELL, *, also: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between text keys whose components are those of all near copies among docs (key, text).

    also (key, cell), where given, has further cells of candidates, held to the same similarity; a key has a cell once.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [bands(shingles(t)).astype(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            flat = pa.array(np.concatenate([np.empty(0, np.int64), *made]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * BANDS, pa.int32()), flat)], ["key", "bands"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            made = [shingles(t).astype(np.int64) for t in some.column(2).cast(pa.binary()).to_pylist()]
            ends = np.cumsum([0, *map(len, made)])
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(made)))], ["units", "key", "found"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

        now, keys, sets = None, [], []
        for batch in batches:
            edges = []
            units, own, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype(np.uint64)
            for i, unit in enumerate(units):
                if unit != now:
                    edges += forest(keys, sets, least) if len(keys) > 1 else []
                    now, keys, sets = unit, [], []
                keys.append(own[i])
                sets.append(flat[ends[i] : ends[i + 1]])
            yield out(edges)
        yield out(forest(keys, sets, least) if len(keys) > 1 else [])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = cut(docs.mapInArrow(sign, "key long, bands array<long>"), "signatures").groupBy("key").agg(F.any_value("bands").alias("bands"), F.count("*").alias("copies"))
    # a key has twenty cells, so keys are dealt out before cells are made of them
    signed = cut(signed.repartition(n, "key"), "distinct")
    wanted = cut(_units(signed, cell, also), "units")
    row = wanted.agg(F.count("*").alias("n"), F.max("copies").alias("copies")).first()
    if not row["n"]:
        return docs.sparkSession.createDataFrame([], "a long, b long")
    if row["n"] <= BROADCAST:
        texts = docs.join(F.broadcast(wanted), "key")
    else:
        bits = filter_bits(row["n"])
        bitmap = cut(digest_filter(wanted.select(F.col("key").alias("digest")), bits), "filter")
        texts = probed(docs.withColumn("digest", F.col("key")), bitmap, bits).filter("maybe").select("key", "text").join(wanted, "key")
    if row["copies"] > 1:
        texts = texts.filter("copies = 1").unionByName(texts.filter("copies > 1").dropDuplicates(["key"]))
    sets = texts.select("units", "key", "text").mapInArrow(read, "units array<long>, key long, found array<long>")
    rows = sets.select(F.explode("units").alias("unit"), "key", "found")
    return rows.repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(search, "a long, b long").distinct()


def _units(signed: DataFrame, cell: int, also: DataFrame | None = None) -> DataFrame:
    """(key, copies, units) of the keys that share a cell: the searches that a key's text takes part in.

    Texts that cells join, over others too, are one cluster. A cluster of at
    most `cell` texts is one search, so each of its texts is dealt out once; of a
    larger one each cell is, and of a larger cell each pair of its chunks.
    """
    keyed = signed.select("key", F.explode("bands").alias("cell"))
    keyed = keyed if also is None else keyed.unionByName(also.select("key", "cell"))
    members = keyed.groupBy("cell").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"), F.bit_xor(F.xxhash64("key")).alias("all"))
    # cells of the same members are one
    cells = cut(members.filter("n > 1").groupBy("n", "low", "high", "all").agg(F.min("cell").alias("cell")).select("cell", "low", "n"), "cells")
    met = cut(keyed.join(cells, "cell"), "met")
    found = cut(components(met.select(F.col("key").alias("a"), F.col("low").alias("b"))), "clusters")
    sizes = found.groupBy("root").agg(F.count("*").alias("size"))
    clusters = cut(found.join(sizes, "root").select("node", "root", "size"), "sizes")
    small = clusters.filter(F.col("size") <= cell).select(F.col("node").alias("key"), F.array(F.xxhash64(F.lit(0), "root")).alias("units"))
    large = met.join(clusters.filter(F.col("size") > cell).select("node"), F.col("key") == F.col("node"), "left_semi")
    large = large.withColumn("chunks", F.ceil(F.col("n") / cell).cast("int")).withColumn("at", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.xxhash64("cell", F.least(j, F.col("at")), F.greatest(j, F.col("at"))))
    large = large.select("key", pairs.alias("units")).groupBy("key").agg(F.flatten(F.collect_list("units")).alias("units"))
    return small.unionByName(large).join(signed.select("key", "copies"), "key")
