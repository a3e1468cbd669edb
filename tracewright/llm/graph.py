"""Connected components of an edge table, without gathering any node's neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import cut


#: Edges that one task may hold, 16 bytes each; with more, rounds of joins.
FEW = 500_000


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least node of each node's component: roots of both ends of each edge are hung under the lesser one, and ways to roots shortened, until no edge joins two."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    u, v = (np.concatenate([b.column(i).to_numpy() for b in got]) for i in (0, 1))
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))  # numbers follow the order of the nodes
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) of every node in edges (a, b) that has a neighbour; root is the least node of its component.

    Up to `few` edges go to one task. More take rounds of large-star and
    small-star: minima are combined before they are dealt out and joined back by
    node, so a node with many neighbours is only a join key, which can be split.
    Each round ends in a table in the shared folder, and there are as many as it
    takes (each is a contraction, so they end).
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    if now.count() <= few:
        return now.coalesce(1).mapInArrow(_roots, "node long, root long")
    total = None
    while True:
        # large star: every neighbour above u goes to the least of u's neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large, "large")
        # small star: u and its lower neighbours go to the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = cut(after, "small")
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == total:
            break
        total = (row["n"], row["h"])
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
