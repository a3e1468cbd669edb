"""Quotas, strata, coverage and harvests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.corpus import ranked
from tracewright.operators.ranges import in_ranges
from tracewright.sources.files import materialised


def round_robin_fill(df: DataFrame, stratum: list[str], order: list, quota: int) -> DataFrame:
    """quota rows, one of each stratum in turn, largest stratum first; a window form of the loop."""
    sizes = df.groupBy(*stratum).agg(F.count("*").alias("__size"))
    # a stratum gives at most quota rows: the others leave before anything is dealt out
    r = ranked(df, stratum, order, "__turn").filter(F.col("__turn") <= F.lit(quota)).join(sizes, stratum)
    picked = r.orderBy("__turn", F.desc("__size"), *stratum, *order).limit(quota)
    return picked.drop("__turn", "__size")


def quota_fill(df: DataFrame, by: list[str], half: str, order: list, targets: DataFrame) -> DataFrame:
    """target rows for each group of by, half of them from each value of half, short halves filled from the other.

    A row's place inside (group, half) decides: up to half the target it comes
    first, beyond that it waits; the target's first rows in that order stay.
    """
    most = targets.agg(F.max("target").alias("n")).first()["n"] or 0
    # a half gives at most its group's target: rows beyond the largest leave before anything is dealt out
    r = ranked(df, [*by, half], order, "__place").filter(F.col("__place") <= F.lit(most)).join(targets, by)
    late = (F.col("__place") > F.ceil(F.col("target") / 2)).cast("int")
    w = Window.partitionBy(*by).orderBy(late, *order)
    return r.withColumn("__k", F.row_number().over(w)).filter("__k <= target").drop("__k", "__place")


#: Groups whose state is broadcast at most, and rounds of a cover after which sets with nothing new are left out.
BROADCAST, PRUNE = 100_000, 8


def _item_bits(sets: DataFrame, items: str) -> tuple[DataFrame, DataFrame]:
    """Sets (g, k, bits) and groups (g, full): bit r of an array of longs is the r-th item of the group by (rows that have it, item)."""
    held = sets.select("g", "k", "n", F.explode(items).alias("item"))
    counts = held.groupBy("g", "item").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("g").orderBy("n", "item")
    # a window over the distinct items of a group, not over its rows
    ranks = materialised(counts.filter("item IS NOT NULL").withColumn("r", F.row_number().over(order) - 1).select("g", "item", "r"), "items")
    words = lambda m: F.floor((m + 63) / 64).cast("int")
    sizes = ranks.groupBy("g").agg((F.max("r") + 1).alias("m"))
    low_bits = lambda m, w: F.when(m >= 64 * (w + 1), F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), m - 64 * w) - 1)
    full = sizes.select("g", F.transform(F.sequence(F.lit(0), words(F.col("m")) - 1), lambda w: low_bits(F.col("m"), w)).alias("full"))
    listed = held.join(ranks, ["g", "item"]).groupBy("g", "k").agg(F.collect_list("r").alias("rs")).join(sizes, "g")
    word = lambda w: F.aggregate("rs", F.lit(0).cast("long"), lambda acc, r: F.when(F.floor(r / 64) == w, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), r % 64))).otherwise(acc))
    return listed.select("g", "k", F.transform(F.sequence(F.lit(0), words(F.col("m")) - 1), word).alias("bits")), full


def greedy_cover(df: DataFrame, key: str, items: str, group: str, quota: int) -> DataFrame:
    """Rows that cover the items of their group: the rarest uncovered item picks the row that covers most, until all are covered or the quota is met.

    All groups choose at once, a round for each choice: a group's state is what
    it has covered (a bit an item), rows that hold the item it looks for are
    scored by what they would add, and one aggregate, combined where the rows
    lie, takes the best; so the rows of a large group stay spread. Of rows with
    the same items only the least key can be picked, so what is scored are the
    distinct sets of a group. Rounds are as many as the longest cover. Rows with
    a null group or without items cover nothing; ties go to the least key.
    """
    rows = df.filter(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("key"), F.array_sort(F.array_distinct(items)).alias("items"))
    sets = rows.groupBy("g", "items").agg(F.min("key").alias("k"), F.count("*").alias("n"))
    bits, full = _item_bits(materialised(sets, "sets"), "items")
    bits = materialised(bits, "bits")
    first = lambda free: F.get(F.filter(F.transform(free, lambda x, w: F.when(x != 0, 64 * w + F.bit_count(x.bitwiseAND(F.negate(x)) - 1))), lambda x: x.isNotNull()), F.lit(0))
    without = lambda x, y: F.zip_with(x, y, lambda a, b: a.bitwiseAND(F.bitwise_not(b)))
    state = full.select("g", "full", F.transform("full", lambda _: F.lit(0).cast("long")).alias("covered"))
    state = materialised(state.select("*", first(F.col("full")).alias("target"), F.lit(None).cast(df.schema[key].dataType).alias("k"), F.lit(0).alias("place")), "cover")
    steps = []
    for place in range(1, quota + 1):
        open_ = state.filter("target IS NOT NULL")
        n = open_.count()
        if not n:
            break
        small = open_.select("g", "covered", "target")
        joined = bits.join(F.broadcast(small) if n <= BROADCAST else small, "g")
        if place % PRUNE == 0:
            joined = materialised(joined.filter(F.exists(without("bits", "covered"), lambda x: x != 0)), "bits")
            bits = joined.select("g", "k", "bits")
        has = F.call_function("shiftright", F.element_at("bits", (F.floor(F.col("target") / 64) + 1).cast("int")), (F.col("target") % 64).cast("int")).bitwiseAND(F.lit(1)) != 0
        adds = F.aggregate(without("bits", "covered"), F.lit(0), lambda acc, x: acc + F.bit_count(x))
        best = joined.filter(has).groupBy("g").agg(F.min(F.struct((-adds).alias("adds"), "k", "bits")).alias("best"))
        now = open_.select("g", "full", "covered").join(best, "g").select("g", "full", F.zip_with("covered", "best.bits", lambda a, b: a.bitwiseOR(b)).alias("covered"), F.col("best.k").alias("k"))
        state = materialised(now.select("g", "full", "covered", first(without("full", "covered")).alias("target"), "k", F.lit(place).alias("place")), "cover")
        steps.append(state.select(F.col("g").alias(group), F.col("k").alias(key), "place"))
    chosen = steps[0] if steps else state.filter("false").select(F.col("g").alias(group), F.col("k").alias(key), "place")
    for s in steps[1:]:
        chosen = chosen.unionByName(s)
    return chosen


def cover_then_fill(df: DataFrame, key: str, items: str, group: str, stratum: str, quota: int) -> DataFrame:
    """(group, key, phase): rows of each group up to its quota, in three phases: cover of the items, strata in turn, then whatever is left, by key.

    Of each stratum at most `quota` rows can be taken, and of a group too, so
    what is ranked after the cover is bounded by strata and quota.
    """
    cover = greedy_cover(df, key, items, group, quota).select(group, key, F.lit(1).alias("phase"))
    have = cover.groupBy(group).agg(F.count("*").alias("__have"))
    rest = df.select(group, key, stratum).join(cover.select(group, key), [group, key], "left_anti")
    turns = ranked(rest, [group, stratum], [key], "__turn").filter(F.col("__turn") <= F.lit(quota))
    # a first row of each stratum, then rows by key
    late = (F.col("__turn") > 1).cast("int")
    fill = turns.withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy(late, F.when(late == 0, F.col(stratum)), key)))
    fill = fill.join(have, group, "left").filter(F.col("__k") + F.coalesce("__have", F.lit(0)) <= quota)
    return cover.unionByName(fill.select(group, key, F.when(F.col("__turn") == 1, 2).otherwise(3).alias("phase")))


def wanted_flags(rate: float, quota: int) -> list[bool]:
    """The flag that is taken next when so many rows are taken: hits follow from the number taken, since a row is taken only where it fits."""
    out, hits = [], 0
    for taken in range(quota):
        out.append(hits < rate * (taken + 1))
        hits += out[-1]
    return out


def balance_rate(df: DataFrame, key: str, flag: str, group: str, rate: float, quota: int, pieces: int | None = None) -> DataFrame:
    """quota rows of each group, in order of key, taken or passed over so that the share of flag stays at rate.

    A parallel scan: rows are cut into ranges of (group, key), and a range is a
    function from the number taken before it to the number taken after it, a
    table of quota + 1 numbers. A group's tables, in order, give where each of its
    ranges starts; then every range picks its rows by itself. A null flag is a
    false one, rows with a null group are left out, rows of equal key go false
    before true; of a group at most quota rows are returned.
    """
    kinds = [df.schema[c].dataType for c in (group, key, flag)]
    if quota <= 0:
        return df.select(group, key, flag).limit(0)
    rows = df.filter(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), F.coalesce(F.col(flag).cast("boolean"), F.lit(False)).alias("f"))
    want = F.array(*map(F.lit, wanted_flags(rate, quota)))
    fits = lambda taken, row: (taken < quota) & (F.get(want, taken) == row["f"])
    dealt = in_ranges(rows, ["g", "k"], "p", pieces).groupBy("g", "p").agg(F.array_sort(F.collect_list(F.struct("k", "f"))).alias("rows"))
    after = F.aggregate("rows", F.sequence(F.lit(0), F.lit(quota)), lambda acc, row: F.transform(acc, lambda t: t + fits(t, row).cast("int")))
    dealt = materialised(dealt.withColumn("after", after), "pieces")
    tables = dealt.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("p", "after"))).alias("tables"))
    none = F.array().cast("array<struct<p:bigint,start:int>>")
    walk = F.aggregate("tables", F.struct(F.lit(0).alias("at"), none.alias("starts")), lambda acc, t: F.struct(F.get(t["after"], acc["at"]).alias("at"), F.concat(acc["starts"], F.array(F.struct(t["p"].alias("p"), acc["at"].alias("start")))).alias("starts")))
    starts = tables.select("g", F.explode(walk["starts"]).alias("s")).select("g", "s.p", "s.start").filter(F.col("start") < quota)
    picks = F.filter("rows", lambda r: F.lit(False))
    pick = F.aggregate("rows", F.struct(F.col("start").alias("at"), picks.alias("taken")), lambda acc, row: F.when(fits(acc["at"], row), F.struct((acc["at"] + 1).alias("at"), F.concat(acc["taken"], F.array(row)).alias("taken"))).otherwise(acc))
    picked = dealt.join(starts, ["g", "p"]).select("g", F.explode(pick["taken"]).alias("r"))
    return picked.select(F.col("g").cast(kinds[0]).alias(group), F.col("r.k").cast(kinds[1]).alias(key), F.col("r.f").cast(kinds[2]).alias(flag))


def hash_uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) from a hash that SQL engines share: the first 13 hex digits of an md5."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *keys).cast("binary"))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(16**13)
