"""Mixing sources to target weights by a low-discrepancy schedule.

Slot j of the mix belongs to the source in whose share of the cumulative target
weights the golden-ratio point frac(j * phi) falls, and to no other: how many
slots a source gets, and when, follows from the points. Slots are ranked inside
their source; a source's documents, in the order of a seeded hash, make one
stream of words that is cut into blocks of equal size, and the slot of rank k
takes block k modulo the number of blocks. Slots that would take a block more
often than `repeats` allows are passed over.

The mix has about SLOTS slots at every size, more where there are many sources
(SLOTS_EACH for each), so what a source takes is off its target by the points'
discrepancy, a few slots, and by less than two blocks for its last, shorter
block. Shares and points are whole numbers, sums are exact, so reruns agree.

Defined cases: a null text has size 0, and takes 0 words; a null source is a
source of its own, ordered last; a source without words has target 0; repeated
rows count each time; ties of the hash go by id, then by size (rows that are
equal in all that returns may change places); an empty table gives an empty
result; extra columns pass through `keep`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import cut, running
from tracewright.operators.ranges import numbered

#: Weights by rank of the source, repeating; how often a source's words may be taken.
WEIGHTS, REPEATS = (5.0, 2.0, 1.0), 3.0
#: Slots of a mix and slots for each source at least; never more than MAX_SLOTS, whose products stay within 63 bits.
SLOTS, SLOTS_EACH, MAX_SLOTS = 1 << 20, 256, 1 << 30
#: Points are multiples of 1 / CIRCLE; PHI, the golden ratio less 1, is the step from one to the next.
CIRCLE, PHI = 1 << 32, (math.sqrt(5) - 1) / 2
#: Parts of a wanted slot that shares are counted in; rows of a piece that is ordered in one task.
FINE, PIECE = 1 << 16, 1024
#: Sources that are broadcast, or sorted in one task, at most; beyond, they are numbered in ranges, and rows meet them in a join salted into SALT parts.
BROADCAST, SALT = 100_000, 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(stats: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: float = REPEATS, few: bool = False) -> DataFrame:
    """Adds source_no, weight and target to (source, source_size, ..), one row a source; few: at most BROADCAST rows, which one task may sort.

    Open sources share what is left in proportion to their weights. That ratio
    only rises as sources stop at `repeats` times their size, so a source has
    stopped just when the last ratio would give it more; each round is one sum.
    """
    if few:
        first = Window.orderBy(F.col("source").isNull(), "source")
        st = stats.withColumn("source_no", (F.row_number().over(first) - 1).cast("long"))
    else:
        named = stats.withColumn("__name", F.concat(F.col("source").isNull().cast("int").cast("string"), F.coalesce("source", F.lit(""))))
        st = numbered(named, "__name", "source_no").drop("__name")
    st = cut(st.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))), "sources")
    most = F.col("source_size") * F.lit(float(repeats))
    row = st.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total, left, whole, stopped = float(row["size"] or 0), float(row["size"] or 0), row["weight"] or 1.0, 0
    while True:
        above = F.lit(left) * F.col("weight") / F.lit(whole) > most if whole else F.lit(True)
        row = st.agg(F.sum(F.when(above, most)).alias("most"), F.sum(F.when(~above, F.col("weight"))).alias("weight"), F.count(F.when(above, 1)).alias("n")).first()
        if row["n"] == stopped:
            break
        left, whole, stopped = total - (row["most"] or 0.0), row["weight"] or 0.0, row["n"]
        if not whole:
            break
    share = F.when(above, most).otherwise(F.lit(left) * F.col("weight") / F.lit(whole)) if whole else most
    return st.withColumn("target", F.greatest(share, F.lit(0.0)))


def shares(goals: DataFrame, block: int, few: bool = False) -> tuple[DataFrame, int]:
    """Adds blocks, low and high to the goals: the arc [low, high) of the circle that is a source's; and the number of slots."""
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    want = F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size") * FINE)).otherwise(F.lit(0)).cast("long")
    rows = goals.withColumn("blocks", blocks).withColumn("want", want).withColumn("__all", F.lit(0))
    whole = rows.agg(F.sum("want").alias("n")).first()["n"] or 0
    at = lambda x: F.floor(x.cast("double") / F.lit(float(max(whole, 1))) * F.lit(float(CIRCLE))).cast("long")
    if few:
        placed = rows.withColumn("before", F.coalesce(F.sum("want").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    else:
        placed = running(rows, "__all", ["source_no"], F.floor(F.col("source_no") / PIECE), F.col("want"), "before")
    arcs = placed.withColumn("low", at(F.col("before"))).withColumn("high", at(F.col("before") + F.col("want")))
    return arcs.drop("__all", "before", "want"), round(whole / FINE)


def schedule(arcs: DataFrame, slots: int, sources: int, repeats: float = REPEATS) -> DataFrame:
    """(source_no, blocks, position, rank) of every slot: position is j, rank counts the slots of a source before it."""
    bits = max(4, (4 * sources).bit_length())
    shift = max(0, CIRCLE.bit_length() - 1 - bits)
    # a circle cut into about four cells for each source: an arc goes to the cells that it meets
    cells = F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift)))
    met = arcs.filter("high > low").select("source_no", "blocks", "low", "high", cells.alias("cell"))
    step = round(PHI * CIRCLE)
    points = arcs.sparkSession.range(slots).select(F.col("id").alias("position"), (F.col("id") * F.lit(step)).bitwiseAND(F.lit(CIRCLE - 1)).alias("u"))
    hit = points.withColumn("cell", F.shiftright("u", shift)).join(met, "cell").filter("u >= low AND u < high").select("source_no", "blocks", "position")
    ranked = running(hit, "source_no", ["position"], F.floor(F.col("position") / PIECE), F.lit(1), "rank")
    return ranked.filter(F.col("rank") < F.floor(F.col("blocks") * F.lit(float(repeats))))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: float = REPEATS, block: int | None = None, seed: int = 13, text: str = "text", source: str = "source", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot, slots and the columns keep of every row of docs.

    first_slot is the first slot of the schedule that takes words of the row
    (null: none does), slots how many do. Only ids, sources and sizes are dealt
    out, never texts. block is the words of a block, by default what gives
    about SLOTS slots.
    """
    keep = keep or []
    rows = docs.select(*keep, F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    # upper bits of the hash order documents and cut a source into pieces
    rows = cut(rows.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size", *keep), 1)), "sizes")
    stats = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n")), "stats")
    row = stats.agg(F.count("*").alias("n"), F.sum("source_size").alias("words")).first()
    sources, words = row["n"], row["words"] or 0
    block = block or max(1, words // min(MAX_SLOTS, max(SLOTS, SLOTS_EACH * sources)))
    few = sources <= BROADCAST
    arcs, slots = shares(targets(stats, weights, repeats, few), block, few)
    arcs = cut(arcs.withColumn("pieces", F.ceil(F.col("n") / PIECE).cast("long")), "arcs")
    known = arcs.select(F.col("source").alias("__name"), "source_no", "source_size", "target", "pieces")
    if few:
        named = rows.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("__name")))
    else:
        salted = known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        named = rows.withColumn("__s", (F.col("h") % SALT).cast("int")).join(salted, F.col("source").eqNullSafe(F.col("__name")) & (F.col("__s") == F.col("__salt"))).drop("__s", "__salt")
    named = named.drop("__name", "source")
    piece = F.floor(F.col("h") / (F.lit(float(2**63)) / F.col("pieces")))
    full = running(named.filter("size > 0"), "source_no", ["h", "doc_id", "size", *keep], piece, F.col("size"), "begin")
    full = cut(full.select(*keep, "doc_id", "size", "source_no", "source_size", "target", "begin"), "placed")
    taken = cut(schedule(arcs, slots, sources, repeats).groupBy("source_no", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count("*").alias("times"), F.min("position").alias("first")), "taken")
    parts = full.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))))
    words_in = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("begin", F.col("block") * block)
    times = F.coalesce("times", F.lit(0))
    joined = parts.join(taken, ["source_no", "block"], "left")
    # begin tells rows of a source apart
    got = joined.groupBy("source_no", "begin", "doc_id", "size", "source_size", "target", *keep).agg(F.sum(words_in * times).cast("long").alias("taken"), F.min("first").alias("first_slot"), F.sum(times).cast("long").alias("slots"))
    every = got.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "slots", *keep)
    none = named.filter("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"), F.lit(0).cast("long").alias("slots"), *keep)
    return every.unionByName(none)
