"""Merging low-rank adapters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.sources.files import materialised


#: Rows of a block of which a triangle is made, and triangles that one task makes one of.
BLOCK, FAN_IN = 4096, 32


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of rows: R^T R is rows^T rows."""
    return np.linalg.qr(rows, mode="r")


def _triangles(rows: DataFrame) -> DataFrame:
    """(module, r) of the blocks that lie in each task: a task holds a block and a triangle for each module."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for module, part in pdf.groupby("module"):
                for i in range(0, len(part), BLOCK):
                    m = np.stack(part["row"].iloc[i : i + BLOCK].to_numpy()).astype(np.float64)
                    held[module] = triangle(np.vstack([held[module], m]) if module in held else m)
        yield pd.DataFrame([(k, r.tobytes()) for k, r in held.items()], columns=["module", "r"])

    return rows.mapInPandas(run, "module long, r binary")


def _stacked(pdf: pd.DataFrame, width: int) -> np.ndarray:
    """One triangle of several, one after the other: two are held at a time."""
    whole = None
    for r in pdf["r"]:
        m = np.frombuffer(r, np.float64).reshape(-1, width)
        whole = m if whole is None else triangle(np.vstack([whole, m]))
    return whole


def svd_merge(factors: DataFrame, rank: int, weights: dict[int, float] | None = None) -> DataFrame:
    """The best rank-`rank` factors of the weighted mean of B_s A_s over snapshots s, for each module.

    factors: module, step, k, embedding; the first half of the vector is a column
    of B_s, the second a row of A_s, so the mean is B^T A of two tall matrices with
    a row for each vector. They stand side by side, and a tree of QR decompositions
    makes one triangle of them: of blocks in every task, of up to FAN_IN triangles
    above, until each module has one, [R1 R2]; Q falls out of B^T A = R1^T R2,
    whose singular values are those of the mean. No task holds more than a block
    and a triangle for each module, and no product of the size of the rows is
    made. Singular values are shared evenly by both factors. Returns module, k,
    singular value and the norms of the columns.
    """
    weight = F.coalesce(*(F.when(F.col("step") == s, F.lit(float(w))) for s, w in (weights or {}).items()), F.lit(1.0))
    steps = factors.groupBy("module", "step").agg(F.first(weight).alias("w")).groupBy("module").agg(F.sum("w").alias("total"))
    width = factors.agg(F.max(F.size("embedding"))).first()[0] or 0
    half = width // 2
    # the weight is on the left half alone, so it may be of either sign
    row = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.when(i < half, x * F.col("w")).otherwise(x))
    level = materialised(_triangles(factors.select("module", "embedding", weight.alias("w")).select("module", row.alias("row"))), "triangles")

    def above(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"module": [pdf["module"].iloc[0]], "r": [_stacked(pdf, width).tobytes()]})

    while (most := level.groupBy("module").count().agg(F.max("count")).first()[0] or 0) > FAN_IN:
        dealt = level.withColumn("at", F.pmod(F.xxhash64("r"), F.lit(-(-most // FAN_IN))))
        level = materialised(dealt.groupBy("module", "at").applyInPandas(lambda pdf: above(pdf[["module", "r"]]), "module long, r binary"), "triangles")

    def decompose(pdf: pd.DataFrame) -> pd.DataFrame:
        r = _stacked(pdf, width)
        whole = r[:, :half].T @ r[:, half:] / pdf["total"].iloc[0]
        u, s, vt = np.linalg.svd(whole, full_matrices=False)
        n = min(rank, len(s))
        b, a = u[:, :n] * np.sqrt(s[:n]), np.sqrt(s[:n])[:, None] * vt[:n]
        return pd.DataFrame({"module": [pdf["module"].iloc[0]] * n, "k": range(n), "singular": s[:n], "b_norm": np.linalg.norm(b, axis=0), "a_norm": np.linalg.norm(a, axis=1)})

    return level.join(steps, "module").groupBy("module").applyInPandas(decompose, "module long, k int, singular double, b_norm double, a_norm double")
