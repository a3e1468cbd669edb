"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time. Texts are cut
into windows of WINDOW bytes (the last one starts early enough to be full;
positions already labelled are not counted again), every position of every
window gets label probabilities, and a document's probabilities are the means
over its positions.

Defined cases: a null text or one without any letter is `und` with score 0; a
text shorter than a window is padded with spaces that are not counted; ties of
probabilities go to the label that sorts first; an empty table, or one without
labelled rows, gives a model without labels, which answers `und` everywhere;
repeated rows are judged each by itself; extra columns pass through when listed
in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import slices

#: Bytes a window holds, hidden units for each direction.
WINDOW, HIDDEN = 64, 8
#: Bounds of what the driver gathers for training: labels, documents for each label, characters of each document.
MAX_LABELS, DOCS_PER_LABEL, SAMPLE_CHARS = 256, 300, 2048
#: Places in which the tasks' candidates for a label meet first.
SLOTS = 128
#: Training steps, windows a step.
STEPS, BATCH = 420, 192
UNKNOWN = "und"


def _softsign(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place."""
    d = np.abs(x)
    d += np.float32(1)
    x /= d
    return x


class BiGru:
    """Weights of both directions: input tables [3H, 256] (bias included), recurrent [3H, H], output [L, 2H] and [L]. Gates are (1 + softsign) / 2."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        r, f, h, n = np.random.default_rng(seed), np.float32, hidden, len(labels)
        self.labels, self.hidden = list(labels), hidden
        self.w = [
            *(r.normal(0, 0.3, (3 * h, 256)).astype(f) for _ in range(2)),
            *(r.normal(0, 0.6 / np.sqrt(h), (3 * h, h)).astype(f) for _ in range(2)),
            r.normal(0, 0.3, (n, 2 * h)).astype(f),
            np.zeros(n, f),
        ]

    def states(self, x: np.ndarray, trace: list | None = None) -> np.ndarray:
        """x: [T, B] byte values. Hidden states [T, 2H, B]; trace gets what backward() needs."""
        (t_max, b), h, f = x.shape, self.hidden, np.float32
        out = np.empty((t_max, 2 * h, b), f)
        for d in (0, 1):
            table, u = self.w[d], self.w[2 + d]
            state, a, g = np.zeros((h, b), f), np.empty((3 * h, b), f), np.empty((3 * h, b), f)
            for t in range(t_max) if d == 0 else range(t_max - 1, -1, -1):
                if trace is not None:
                    g, a = np.empty_like(g), np.empty_like(a)
                np.take(table, x[t], axis=1, out=g, mode="clip")
                np.matmul(u, state, out=a)
                gates = g[: 2 * h]
                gates += a[: 2 * h]
                _softsign(gates)
                gates *= f(0.5)
                gates += f(0.5)
                z, r, c, rec = g[:h], g[h : 2 * h], g[2 * h :], a[2 * h :]
                c += r * rec
                _softsign(c)
                new = out[t, d * h : (d + 1) * h]
                np.subtract(state, c, out=new)
                new *= z
                new += c
                if trace is not None:
                    trace.append((d, t, state, z, r, c, rec))
                state = new
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        p = np.matmul(self.w[4], states)
        p += self.w[5][:, None]
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return p

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Of the mean cross-entropy over the positions of mask [T, B], y [B] being each window's label; by backpropagation through time."""
        h, f, trace = self.hidden, np.float32, []
        s = self.states(x, trace)
        p = self.probabilities(s)
        n, cols = mask.sum(), np.arange(len(y))
        loss = float(-(np.log(p[:, y, cols] + 1e-9) * mask).sum() / n)
        p[:, y, cols] -= 1
        p *= (mask / n)[:, None, :]
        grads = [np.zeros_like(w) for w in self.w]
        grads[4] = np.einsum("tlb,thb->lh", p, s, optimize=True)
        grads[5] = p.sum((0, 2))
        ds = np.matmul(self.w[4].T, p)
        pre = [np.empty((x.shape[0], 3 * h, x.shape[1]), f) for _ in range(2)]
        carry = [np.zeros((h, x.shape[1]), f) for _ in range(2)]
        for d, t, before, z, r, c, rec in reversed(trace):
            dh = ds[t, d * h : (d + 1) * h] + carry[d]
            g = pre[d][t]
            dc = dh * (1 - z) * (1 - np.abs(c)) ** 2
            # a gate is (1 + s) / 2, so |s| is |2 gate - 1|
            g[:h] = 0.5 * dh * (before - c) * (1 - np.abs(2 * z - 1)) ** 2
            g[h : 2 * h] = 0.5 * dc * rec * (1 - np.abs(2 * r - 1)) ** 2
            g[2 * h :] = dc
            da = np.concatenate([g[: 2 * h], dc * r])
            grads[2 + d] += da @ before.T
            carry[d] = dh * z + self.w[2 + d].T @ da
        flat = x.ravel()
        for d in (0, 1):
            for i in range(3 * h):
                grads[d][i] = np.bincount(flat, weights=pre[d][:, i].ravel(), minlength=256)
        return grads, loss

    def predict(self, texts: list[bytes | None], block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Label index (-1: none) and score of each text."""
        n, labels = len(texts), len(self.labels)
        if not labels:
            return np.full(n, -1), np.zeros(n)
        total = np.zeros((labels, n))
        sizes = np.fromiter((len(b) if b else 0 for b in texts), np.int64, n)
        data = np.frombuffer(b"".join(b.ljust(WINDOW) if len(b) < WINDOW else b for b in texts if b), np.uint8)
        begins = np.zeros(n, np.int64)
        begins[1:] = np.cumsum(np.where(sizes == 0, 0, np.maximum(sizes, WINDOW)))[:-1] if n else 0
        counts = -(-sizes // WINDOW)
        doc = np.repeat(np.arange(n), counts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = np.minimum(nth * WINDOW, np.maximum(sizes[doc] - WINDOW, 0))
        low, high = nth * WINDOW - start, np.minimum(WINDOW, sizes[doc] - start)
        at, steps = begins[doc] + start, np.arange(WINDOW)[:, None]
        for i in range(0, len(doc), block):
            k = slice(i, i + block)
            p = self.probabilities(self.states(data[at[k][None, :] + steps].astype(np.intp)))
            p *= ((steps >= low[k]) & (steps < high[k]))[:, None, :]
            pooled = p.sum(0)
            for j in range(labels):
                total[j] += np.bincount(doc[k], weights=pooled[j], minlength=n)
        best = total.argmax(0)
        score = np.clip(total[best, np.arange(n)] / np.maximum(sizes, 1), 0, 1)
        return np.where(sizes > 0, best, -1), score


def train(samples: list[tuple[bytes, str]], steps: int = STEPS, batch: int = BATCH, seed: int = 11) -> BiGru:
    """A network from (text, label) pairs; labels are drawn evenly, windows evenly inside a label. Same pairs in the same order, same network."""
    labels = sorted({y for _, y in samples})
    net = BiGru(labels)
    if len(labels) < 1 or not any(b for b, _ in samples):
        return BiGru([])
    rng, f = np.random.default_rng(seed), np.float32
    pools = [[b for b, y in samples if y == name and b] or [b" "] for name in labels]
    m, v = [np.zeros_like(w) for w in net.w], [np.zeros_like(w) for w in net.w]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(labels), batch)
        x, mask = np.full((WINDOW, batch), 32, np.intp), np.zeros((WINDOW, batch), f)
        for i, label in enumerate(y):
            text = pools[label][rng.integers(len(pools[label]))]
            at = rng.integers(0, max(1, len(text) - WINDOW + 1))
            piece = np.frombuffer(text, np.uint8, min(WINDOW, len(text)), at)
            x[: len(piece), i], mask[: len(piece), i] = piece, 1
        grads, _ = net.gradients(x, y, mask)
        norm = float(np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads)))
        rate = 0.02 * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for i, g in enumerate(grads):
            g = (g * f(min(1.0, 1.0 / (norm + 1e-9)))).astype(f)
            m[i] += f(0.1) * (g - m[i])
            v[i] += f(0.01) * (g * g - v[i])
            net.w[i] -= (f(rate) * (m[i] / f(1 - 0.9**step)) / (np.sqrt(v[i] / f(1 - 0.99**step)) + f(1e-8))).astype(f)
    return net


def is_held_out(doc_id) -> F.Column:
    """crc32 of the id as text, mod 5, is 0; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, per_label: int = DOCS_PER_LABEL) -> list[tuple[bytes, str]]:
    """per_label documents of each label, or all where there are fewer, and a window of SAMPLE_CHARS characters from anywhere in each, of rows that aren't held out.

    Those of the least hashes of id and text are taken, so reruns agree, rows that
    share an id are drawn apart; repeated rows count each. At most per_label rows of
    a label leave a task; they meet in SLOTS places, and what those leave meets by
    label, so no task reads more than its share of the tasks' rows or SLOTS *
    per_label of them. The driver gets per_label windows a label. The bound is on
    labelled rows that a network is fitted on, and on how much of each; predictions
    read whole texts.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    labels = rows.select("lang").distinct().limit(MAX_LABELS + 1).count()
    if labels > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    # a rank with a bound: Spark keeps per_label rows of a label in each task before anything is dealt out
    at = F.xxhash64("doc_id", "text", F.lit("sample"))
    skip = F.pmod(F.xxhash64("doc_id", "text", F.lit("offset")), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int")
    drawn = rows.select("lang", at.alias("at"), F.substring("text", skip + 1, F.lit(SAMPLE_CHARS)).alias("t"), (F.spark_partition_id() % SLOTS).alias("slot"))
    least = lambda df, *by: df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("at"))).filter(F.col("k") <= per_label).drop("k")
    first = least(least(drawn, "lang", "slot"), "lang")
    return [(r["t"].encode(), r["lang"]) for r in first.select("lang", "at", "t").orderBy("lang", "at").collect()]


def fit(docs: DataFrame, per_label: int = DOCS_PER_LABEL, steps: int = STEPS) -> BiGru:
    return train(labelled_sample(docs, per_label), steps)


def identify(df: DataFrame, net: BiGru, text: str = "text", keep: list[str] | None = None, label: str = "lang_pred", score: str = "score", reject_below: float | None = None) -> DataFrame:
    """The columns keep (all by default) of df, with label and score.

    With reject_below, rows that are `und` or score less go, and only the
    columns keep return. Columns of df named like label or score go to the new values.
    """
    keep = [c for c in (df.columns if keep is None else keep) if reject_below is not None or c not in (label, score)]
    names = [f"c{i}" for i in range(len(keep))]
    source = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)), F.col(f"`{text}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            column = batch.column(batch.num_columns - 1)
            texts = column.to_pylist()
            lettered = [t is not None and any(map(str.isalpha, t)) for t in texts]
            best, sure = net.predict([t.encode() if ok else None for t, ok in zip(texts, lettered, strict=True)])
            del texts
            kept = [batch.column(i) for i in range(len(names))]
            if reject_below is not None:
                stay = pa.array((best >= 0) & (sure >= reject_below))
                out = pa.RecordBatch.from_arrays(kept, names).filter(stay)
            else:
                found = pa.array([net.labels[i] if i >= 0 else UNKNOWN for i in best], pa.string())
                out = pa.RecordBatch.from_arrays([*kept, found, pa.array(np.where(best >= 0, sure, 0.0))], [*names, "l", "s"])
            yield out

    kept = source.select(*names).schema
    made = source.mapInArrow(run, kept if reject_below is not None else kept.add("l", "string").add("s", "double"))
    cols = [F.col(n).alias(c) for n, c in zip(names, keep, strict=True)]
    return made.select(*cols, *([] if reject_below is not None else [F.col("l").alias(label), F.col("s").alias(score)]))
