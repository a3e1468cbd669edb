"""Global numbers and range joins that don't put all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.sources.files import materialised


#: Pieces whose sums are summed in one task.
PARTS = 1024


def running(df: DataFrame, key: str, order: list[str], part: Column, value: Column, out: str, levels: int = 1) -> DataFrame:
    """Sum of value over the rows of a key that come before each row, in (part, order).

    part is a number that rises with the order and splits a key into pieces that
    fit a task, so that a key with a third of all rows is spread: sums per
    (key, part) are gathered first, and only inside a piece are rows sorted. The
    sums are summed in the same way, PARTS pieces at a time, levels deep.
    """
    p, v, base = f"__part{levels}", f"__value{levels}", f"__base{levels}"
    df = df.withColumn(p, part).withColumn(v, value)
    sums = df.groupBy(F.col(key).alias("__k"), F.col(p).alias("__p")).agg(F.sum(v).alias("__v"))
    if levels:
        sums = running(sums, "__k", ["__p"], F.floor(F.col("__p") / PARTS), F.col("__v"), base, levels - 1)
    else:
        before = Window.partitionBy("__k").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn(base, F.coalesce(F.sum("__v").over(before), F.lit(0)))
    sums = sums.select(F.col("__k").alias("__key"), F.col("__p").alias("__at"), base)
    inside = Window.partitionBy(key, p).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__in", F.coalesce(F.sum(v).over(inside), F.lit(0)))
    joined = df.join(sums, df[key].eqNullSafe(sums["__key"]) & (df[p] == sums["__at"]))
    return joined.withColumn(out, F.col(base) + F.col("__in")).drop(p, v, base, "__in", "__key", "__at")


def numbered(df: DataFrame, order: str, out: str = "row_no", total: str | None = None) -> DataFrame:
    """Numbers 0, 1, .. in the order of a column without repeats: ranges of it are numbered apart, after the counts of those before."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = df.repartitionByRange(n, order).withColumn("__p", F.spark_partition_id())
    # a range is a partition: bounds of equal input are equal, so the count below meets the same ranges
    parts = materialised(parts)
    counts = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = counts.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"), F.sum("__n").over(every).alias("__all"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1
    made = parts.join(base, "__p").withColumn(out, F.col("__base") + inside)
    return (made.withColumn(total, F.col("__all")) if total else made).drop("__p", "__base", "__all")


def tile(row_no: Column, rows: Column, tiles: int) -> Column:
    """ntile of a row number that counts from 0: the first tiles are one larger where sizes differ."""
    small, more = F.floor(rows / tiles), rows % tiles
    edge = more * (small + 1)
    return F.when(row_no < edge, F.floor(row_no / (small + 1)) + 1).otherwise(more + F.floor((row_no - edge) / F.greatest(small, F.lit(1))) + 1).cast("int")


def in_ranges(df: DataFrame, order: list[str], out: str = "__piece", pieces: int | None = None) -> DataFrame:
    """df as a table with the number of the range that each row is in: ranges rise with the order, are about equal, and rows that are equal in it share one."""
    n = pieces or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return materialised(df.repartitionByRange(n, *order).withColumn(out, F.spark_partition_id().cast("long")))


def _by_key(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """An inner join that shuffles both sides. Spark takes the size of exploded blocks for that of the rows that they came from, and would send tens of millions of them through the driver."""
    return left.hint("merge").join(right.hint("merge"), on)


def _shifted(x: Column, k: Column, up: bool) -> Column:
    """x / 2^k, rounded up or down, of whole numbers of either sign."""
    return F.negate(F.call_function("shiftright", F.negate(x), k)) if up else F.call_function("shiftright", x, k)


def dyadic_nodes(low: Column, high: Column) -> Column:
    """The fewest aligned blocks of 2^k whole numbers that are low..high together, as (k, number of the block): at most two for each k, none where high is below low."""
    end = high + 1

    def of_level(k: Column) -> Column:
        l, r = _shifted(low, k, True), _shifted(end, k, False)
        first, last = F.when((l < r) & (l.bitwiseAND(F.lit(1)) == 1), l), F.when((l < r) & (r.bitwiseAND(F.lit(1)) == 1), r - 1)
        return F.filter(F.array(F.struct(k.alias("k"), first.alias("at")), F.struct(k.alias("k"), last.alias("at"))), lambda n: n["at"].isNotNull())

    top = F.floor(F.log2(F.greatest(end - low, F.lit(1)).cast("double"))).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), top), of_level))


def stabbed(points: DataFrame, intervals: DataFrame, at: Column, low: Column, high: Column) -> DataFrame:
    """Rows of points beside those of intervals whose floor(low)..floor(high) holds floor(at), each pair once.

    A point lies in one block of each size, an interval is a few blocks that are
    apart; so they meet by an equal join, in one block or none, and a pair that
    meets is a result: no key gathers rows that don't belong together. Blocks are
    at most as large as the widest interval, which settles how many a point has.
    """
    widest = intervals.agg(F.max(F.floor(high) - F.floor(low) + 1)).first()[0]
    if widest is None or widest < 1:
        top = -1
    else:
        top = int(widest).bit_length() - 1
    blocks = intervals.withColumn("__node", F.explode(dyadic_nodes(F.floor(low), F.floor(high))))
    levels = F.sequence(F.lit(0), F.lit(max(top, 0)))
    met = points.withColumn("__node", F.explode(F.transform(levels, lambda k: F.struct(k.alias("k"), _shifted(F.floor(at), k, False).alias("at")))))
    return _by_key(met, blocks, "__node").drop("__node")


def overlap_join(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Pairs whose closed intervals overlap, of any widths up to 2^62: the later start lies in the other interval.

    Rows go to as many blocks as the logarithm of a width, not to as many as the
    width. Intervals with a null end, or an end below the start, overlap nothing.
    """
    la, ha, lb, hb = F.col(a[0]), F.col(a[1]), F.col(b[0]), F.col(b[1])
    fine_l, fine_r = left.filter(la <= ha), right.filter(lb <= hb)
    starts_right = stabbed(fine_l, fine_r, la, lb, hb).filter((lb <= la) & (la <= hb))
    starts_left = stabbed(fine_r, fine_l, lb, la, ha).filter((la < lb) & (lb <= ha))
    names = [*left.columns, *right.columns]
    return starts_right.select(*names).unionByName(starts_left.select(*names))


def _levels(intervals: DataFrame, width: Column) -> Column:
    """The sizes of block that intervals are made of."""
    widest = intervals.agg(F.max(width)).first()[0]
    return F.sequence(F.lit(0), F.lit(max(0, int(widest or 1).bit_length() - 1)))


def overlap_totals(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], value: str) -> DataFrame:
    """Left rows that overlap any right one, with `n`, how many, and `first`, the least value of these. Ends are whole numbers.

    The pairs of overlap_join are never met: what starts inside an interval is
    summed by block, what an interval's start lies in too, and a block is one row
    of sums. Rows are as many as the logarithms of the widths.
    """
    sums = [F.sum("n").alias("n"), F.min("first").alias("first")]
    la, ha, lb, hb = F.col(a[0]), F.col(a[1]), F.col(b[0]), F.col(b[1])
    fine_l = left.filter(la <= ha)
    fine_r = right.filter(lb <= hb).groupBy(lb.alias("__l"), hb.alias("__h")).agg(F.count("*").alias("n"), F.min(value).alias("first"))
    spans = fine_l.select(la.alias("__low"), ha.alias("__high")).distinct()

    def in_blocks(at: str, levels: Column) -> Column:
        return F.explode(F.transform(levels, lambda k: F.struct(k.alias("k"), _shifted(F.col(at), k, False).alias("at"))))

    starts = fine_r.groupBy("__l").agg(*sums).withColumn("__node", in_blocks("__l", _levels(spans, F.col("__high") - F.col("__low") + 1))).groupBy("__node").agg(*sums)
    inside = _by_key(spans.withColumn("__node", F.explode(dyadic_nodes(F.col("__low"), F.col("__high")))), starts, "__node").groupBy("__low", "__high").agg(*sums)
    # begun before, and not ended: the start lies in l + 1..h
    begun = fine_r.filter("__l < __h").withColumn("__node", F.explode(dyadic_nodes(F.col("__l") + 1, F.col("__h")))).groupBy("__node").agg(*sums)
    around = _by_key(spans.select("__low").distinct().withColumn("__node", in_blocks("__low", _levels(fine_r, F.col("__h") - F.col("__l")))), begun, "__node").groupBy("__low").agg(*sums)
    every = inside.unionByName(_by_key(spans, around, "__low")).groupBy("__low", "__high").agg(*sums)
    return _by_key(fine_l, every, (la == F.col("__low")) & (ha == F.col("__high"))).select(*left.columns, "n", "first")
