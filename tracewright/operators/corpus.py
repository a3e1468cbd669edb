"""Assembly of corpora: swap joins, gates, oversampling, keep-first, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.ranges import running


def swap_join(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with columns replaced by those of changes where the key is there; changes holds a key once."""
    new = changes.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in columns))
    joined = base.join(new, base[key] == F.col("__k"), "left")
    swapped = F.col("__k").isNotNull()
    return joined.select(*(F.when(swapped, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns), swapped.alias("swapped"))


def strict_lookup(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """A join that fails on a key without a partner."""
    o = other.withColumnRenamed(key, "__k")
    joined = df.join(o, df[key] == F.col("__k"), "left")
    return joined.withColumn("__k", F.when(F.col("__k").isNull(), F.raise_error(F.concat(F.lit("no such key: "), F.col(key).cast("string"))).cast(o.schema["__k"].dataType)).otherwise(F.col("__k"))).filter("__k IS NOT NULL").drop("__k")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order; unlike dropDuplicates the same one each run."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def oversample(df: DataFrame, factor: Column, copy: str = "copy") -> DataFrame:
    """Each row as often as factor says; none for 0, null or what isn't a number."""
    n = F.coalesce(factor.try_cast("int"), F.lit(0))
    return df.filter(n > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), n)))


def gate(matched: Column, tokens: Column, factor: Column, limit: int) -> Column:
    """The factor where the answer matched and the trace is short enough, else 0."""
    return F.when((matched == "True") & (tokens.try_cast("int") < limit), factor.try_cast("int")).otherwise(F.lit(0))


def row_hash(df: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).cast("binary"), 256)


def hash_order(seed: int, *keys: str) -> Column:
    """A shuffle that doesn't depend on partitions: order by this, then by the keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *keys).cast("binary"))


def ranked(df: DataFrame, by: list[str], order: list, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def ranked_by_pieces(df: DataFrame, by: list[str], order: list, piece: Column, out: str = "rank") -> DataFrame:
    """ranked for groups of any size: piece is a whole number that rises with the order, and only rows of a piece are sorted together."""
    keyed = df.withColumn("__by", F.struct(*by))
    return running(keyed, "__by", order, piece, F.lit(1), "__before").withColumn(out, (F.col("__before") + 1).cast("int")).drop("__by", "__before")


def hash_piece(h: str) -> Column:
    """The piece of a hash_order: one of a million, by its first five digits."""
    return F.conv(F.substring(h, 1, 5), 16, 10).cast("long")
