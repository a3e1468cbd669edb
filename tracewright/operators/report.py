"""Aggregates that reports of runs need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.ranges import running


def counted_places(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, __before and __all: how many rows of a group have a lesser value, and how many it has.

    From counts of distinct values, summed by pieces: neither a group's rows nor
    its distinct values are ever in one task.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("__n")).withColumn("__by", F.struct(*by))
    placed = running(counts, "__by", [value], F.floor(F.col(value)), F.col("__n"), "__before")
    sizes = counts.groupBy("__by").agg(F.sum("__n").alias("__all"))
    return placed.join(sizes, "__by").drop("__by")


def nth(value: str, place: Column) -> Column:
    """Aggregate over counted_places: the value at a place, counting from 0, in sorted order."""
    return F.min(F.when(F.col("__before") + F.col("__n") > place, F.col(value)))


def index_quantile(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """The value at place int(n * q), counting from 0, in sorted order: no interpolation."""
    at = lambda q: F.least(F.floor(F.col("__all") * q), F.col("__all") - 1)
    return counted_places(df, by, value).groupBy(*by).agg(*(nth(value, at(q)).alias(name) for name, q in points.items()))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n): equal bins from least to greatest value, which is in the last."""
    ends = df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    b = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1)) * bins)).cast("int")
    return df.crossJoin(F.broadcast(ends)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))  # ends is one row


def flips(cells: list[Column]) -> Column:
    """Whether runs disagree, nulls left out."""
    return F.size(F.array_distinct(F.array_compact(F.array(*cells)))) > 1


def rate(flag: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(weight * flag.cast("int")), F.sum(weight))


def leave_one_out(df: DataFrame, target: str, predictors: dict[str, list[str]]) -> DataFrame:
    """predictor, rows, told, hits, accuracy, rank: how well the mode of a row's group, of the other rows in it, says its target.

    A row's own vote is taken away by arithmetic: only the group's most frequent
    value and the next matter, so a predictor is one count of (group, value) and
    rows are never joined to themselves. Ties go to the smaller value. Rows with
    a null target aren't scored and don't vote; a row alone in its group is told
    nothing. Predictors rank by hits, then by name.
    """
    scored = None
    for name, by in predictors.items():
        group = F.struct(*(F.col(c) for c in by)) if by else F.lit(0)
        counts = df.filter(F.col(target).isNotNull()).groupBy(group.alias("g"), F.col(target).alias("v")).agg(F.count("*").alias("n"))
        sized = counts.groupBy("g").agg(F.sum("n").alias("rows"), F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("first"))
        others = counts.join(sized, "g").filter(F.col("v") != F.col("first.v")).groupBy("g").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("next"))
        both = sized.join(others, "g", "left").select("rows", (-F.col("first.n")).alias("n1"), F.col("first.v").alias("v1"), F.coalesce(-F.col("next.n"), F.lit(0)).alias("n2"), F.col("next.v").alias("v2"))
        # a row of another value leaves the first one first; a row of the first one takes a vote from it
        stays = (F.col("n1") - 1 > F.col("n2")) | ((F.col("n1") - 1 == F.col("n2")) & (F.col("n2") > 0) & (F.col("v1") < F.col("v2")))
        one = both.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("rows") > 1, F.col("rows")).otherwise(0)), F.lit(0)).alias("told"), F.coalesce(F.sum(F.when(stays, F.col("n1")).otherwise(0)), F.lit(0)).alias("hits")).select(F.lit(name).alias("predictor"), "*")
        scored = one if scored is None else scored.unionByName(one)
    # a row a predictor
    order = Window.orderBy(F.desc("hits"), "predictor")
    return scored.select("*", F.when(F.col("told") > 0, F.round(F.col("hits") / F.col("told"), 6)).alias("accuracy"), F.row_number().over(order).alias("rank"))
