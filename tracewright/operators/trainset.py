"""Training examples: masks, shifts, interleaving, batches, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.corpus import ranked_by_pieces


def mask_and_shift(prompt: Column, completion: Column, limit: int) -> Column:
    """Struct (tokens, targets, weights) of token arrays: cut to limit, loss on the completion, targets one ahead."""
    ids = F.slice(F.concat(prompt, completion), 1, limit)
    n, p = F.size(ids), F.least(F.size(prompt), F.size(ids))
    mask = F.concat(F.array_repeat(F.lit(0), p), F.array_repeat(F.lit(1), n - p))
    short = F.greatest(n - 1, F.lit(0))
    return F.struct(F.slice(ids, F.lit(1), short).alias("tokens"), F.slice(ids, F.lit(2), short).alias("targets"), F.slice(mask, F.lit(2), short).alias("weights"))


def padded(ids: Column, width: Column, fill: int = 0) -> Column:
    """Struct (ids, mask): ids filled up to width, and which of them are real."""
    more = F.greatest(width - F.size(ids), F.lit(0))
    return F.struct(F.concat(ids, F.array_repeat(F.lit(fill), more)).alias("ids"), F.concat(F.transform(ids, lambda x: F.lit(1)), F.array_repeat(F.lit(0), more)).alias("mask"))


def micro_batches(df: DataFrame, row_no: str, ids: str, size: int, fill: int = 0) -> DataFrame:
    """df with micro, width and padded: rows by number, `size` at a time, each as wide as the widest of its micro-batch."""
    numbered = df.withColumn("micro", F.floor(F.col(row_no) / size))
    # widths are one number a micro-batch; arrays are joined to them, not gathered
    widths = numbered.groupBy("micro").agg(F.max(F.size(ids)).alias("width"))
    return numbered.join(widths, "micro").withColumn("padded", padded(F.col(ids), F.col("width"), fill))


def preference_side(prompt: Column, answer: Column, emitted: Column, end_id: int, limit: int) -> Column:
    """Struct (ids, mask) of a side of a preference pair: the end id follows only where it was emitted; loss on what the model wrote."""
    written = F.concat(answer, F.when(emitted, F.array(F.lit(end_id))).otherwise(F.array().cast("array<int>")))
    ids = F.slice(F.concat(prompt, written), 1, limit)
    p = F.least(F.size(prompt), F.size(ids))
    return F.struct(ids.alias("ids"), F.concat(F.array_repeat(F.lit(0), p), F.array_repeat(F.lit(1), F.size(ids) - p)).alias("mask"))


def interleave(df: DataFrame, stratum: str, order: list, piece: Column, out: str = "position") -> DataFrame:
    """Each stratum spread evenly: a row's key is its rank over the stratum's size; piece rises with the order."""
    n = df.groupBy(stratum).agg(F.count("*").alias("__n"))
    r = ranked_by_pieces(df, [stratum], order, piece, "__r").join(n, stratum)
    return r.withColumn(out, (F.col("__r") - 1) / F.col("__n")).drop("__r", "__n")


def linear(step: Column, steps: int, peak: float) -> Column:
    return F.lit(peak) * (1 - step / steps)


def warm_cosine(step: Column, steps: int, peak: float, share: float = 0.05) -> Column:
    warm = max(1, round(steps * share))
    return F.when(step < warm, F.lit(peak) * (step + 1) / warm).otherwise(F.lit(peak) * 0.5 * (1 + F.cos(F.lit(math.pi) * (step - warm) / max(1, steps - warm))))


def warm_stable_decay(step: Column, steps: int, peak: float, warm: float = 0.05, decay: float = 0.2) -> Column:
    w, d = max(1, round(steps * warm)), max(1, round(steps * decay))
    return F.when(step < w, F.lit(peak) * (step + 1) / w).when(step < steps - d, F.lit(peak)).otherwise(F.lit(peak) * (steps - step) / d)


def log_sum_exp(values: Column, temperature: float = 1.0) -> Column:
    """Stable: the greatest is taken out first."""
    top = F.array_max(values)
    return top + temperature * F.log(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp((x - top) / temperature)))


def mean_loss(losses: Column, weights: Column) -> Column:
    """Sum of loss times weight over the sum of weights, 0 where there is none."""
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.try_divide(add(F.zip_with(losses, weights, lambda c, w: c * w)), add(weights)), F.lit(0.0))
