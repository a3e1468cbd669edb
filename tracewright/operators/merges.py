"""Merged tokens learned from a corpus: pairs of neighbouring symbols, the most frequent first.

Words are counted first, so that a round goes over distinct words. Some thousand
of them are a block: one array of the numbers of their symbols. A symbol is a run
of bytes, told by its hex. The counts of pairs are small (pairs of symbols, of
which there are 256 and one a merge) and are held in the driver; a round goes
over the blocks and returns how much each count changes.

A round tries the next few merges in the order of the counts so far, each upon
the one before, and tells their changes apart; as many are kept as were right,
that is as many as have the highest count when their turn comes. So results are
those of one merge a round.

Defined cases: words are runs of other than blank signs; a null text has none;
ties go to the smaller pair; pairs counted less than `least` times are never
merged, so there may be fewer merges than asked for; counts go by all positions,
so that aaa holds the pair (a, a) twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.sources.files import materialised

#: Merges tried in a round; merges after which words are written anew.
TRIED, WRITE = 12, 24
#: Merges that are written out in a plan; more are an array that is walked.
NESTED = 64

MERGES = "rank int, left string, right string, n long"


def symbols(word: Column) -> Column:
    """A word as its bytes, each a symbol."""
    return F.regexp_replace(F.hex(word.cast("binary")), "(..)", "<$1>")


def words(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) of all texts."""
    found = docs.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", -1)).alias("word")).filter("word <> ''")
    # words are small: as many tasks as there are cores, whatever their bytes
    return found.groupBy("word").agg(F.count("*").alias("n")).repartition(4 * docs.sparkSession.sparkContext.defaultParallelism)


def _rules(pairs: list[tuple[str, str]]) -> Column:
    """Merges as an array of replacements: a plan stays small however many there are."""
    return F.array(*(F.struct(F.lit(i).alias("step"), F.lit(f"<{a}><{b}>").alias("old"), F.lit(f"<{a}{b}>").alias("new")) for i, (a, b) in enumerate(pairs)))


def merged(s: Column, pairs: list[tuple[str, str]]) -> Column:
    """A word after the merges, one after the other: up to NESTED as one expression that Spark compiles."""
    if len(pairs) > NESTED:
        return F.aggregate(_rules(pairs), s, lambda now, m: F.replace(now, m["old"], m["new"]))
    for a, b in pairs:
        s = F.replace(s, F.lit(f"<{a}><{b}>"), F.lit(f"<{a}{b}>"))
    return s


#: A block: numbers of symbols, END behind each word, and the words' counts.
BLOCK = "flat binary, uses binary"
END = -1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block of each batch of (word as bytes, n)."""
    for batch in batches:
        words, n = batch.column("word").to_pylist(), np.array(batch.column("n").to_pylist(), np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.full(int(sizes.sum()) + len(words), END, np.int32)
        flat[np.arange(sizes.sum()) + np.repeat(np.arange(len(words)), sizes)] = np.frombuffer(b"".join(words), np.uint8)
        yield pa.RecordBatch.from_pydict({"flat": pa.array([flat.tobytes()], pa.binary()), "uses": pa.array([n.tobytes()], pa.binary())})


def _pair_sums(flat: np.ndarray, uses: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(left << 32 | right, uses) of the pairs that begin at the places, summed; a place may be named twice and is one."""
    at = np.unique(at)
    at = at[(at >= 0) & (at < len(flat) - 1)]
    at = at[(flat[at] != END) & (flat[at + 1] != END)]
    keys, inverse = np.unique(flat[at].astype(np.int64) << 32 | flat[at + 1], return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, inverse, uses[at])
    return keys, sums


def _merge(flat: np.ndarray, uses: np.ndarray, left: int, right: int, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and uses of their words after a merge, places of what is merged before, and where the new symbols are after."""
    at = np.flatnonzero((flat[:-1] == left) & (flat[1:] == right))
    if left == right and len(at):
        # in a run every other one, from the left
        starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        at = at[(np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))) % 2 == 0]
    if not len(at):
        return flat, uses, at, at
    stays = np.ones(len(flat), bool)
    stays[at + 1] = False
    flat = flat.copy()
    flat[at] = new
    return flat[stays], uses[stays], at, at - np.arange(len(at))


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols of each block, and of each the uses of its word."""
    for flat, uses in zip(batch.column("flat").to_pylist(), batch.column("uses").to_pylist(), strict=True):
        flat = np.frombuffer(flat, np.int32)
        yield flat, np.repeat(np.frombuffer(uses, np.int64), np.diff(np.flatnonzero(flat == END), prepend=-1))


def _summed(rows: DataFrame) -> list[tuple[int, int, int, int]]:
    """(step, left, right, by) of what blocks give."""
    sums = rows.groupBy("step", "pair").agg(F.sum("by").alias("by")).filter("by <> 0")
    return [(r["step"], r["pair"] >> 32, r["pair"] & 0xFFFFFFFF, r["by"]) for r in sums.collect()]


def _rows(step: int, keys: np.ndarray, by: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"step": pa.array(np.full(len(keys), step, np.int32)), "pair": pa.array(keys), "by": pa.array(by)})


CHANGE = "step int, pair long, by long"


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of a block."""
    for batch in batches:
        for flat, uses in _opened(batch):
            yield _rows(0, *_pair_sums(flat, uses, np.arange(len(flat))))


def _changes(state: DataFrame, pending: list[tuple[int, int, int]], tried: list[tuple[int, int, int]]) -> list[dict[tuple[int, int], int]]:
    """How each of the merges, upon those before and what is pending, changes the counts of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for flat, uses in _opened(batch):
                for rule in pending:
                    flat, uses, _, _ = _merge(flat, uses, *rule)
                for step, rule in enumerate(tried):
                    before, before_uses = flat, uses
                    flat, uses, old, new = _merge(flat, uses, *rule)
                    keys, by = _pair_sums(before, before_uses, np.concatenate([old - 1, old, old + 1]))
                    yield _rows(step, keys, -by)
                    yield _rows(step, *_pair_sums(flat, uses, np.concatenate([new - 1, new])))

    out: list[dict] = [{} for _ in tried]
    for step, left, right, by in _summed(state.mapInArrow(run, CHANGE)):
        out[step][left, right] = by
    return out


def _written(state: DataFrame, pending: list[tuple[int, int, int]]) -> DataFrame:
    """Blocks after the merges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for flat, uses in _opened(batch):
                for rule in pending:
                    flat, uses, _, _ = _merge(flat, uses, *rule)
                made.append(flat.tobytes())
            yield pa.RecordBatch.from_pydict({"flat": pa.array(made, pa.binary()), "uses": batch.column("uses")})

    return materialised(state.mapInArrow(run, BLOCK), "words")


def learn(counted: DataFrame, merges: int, least: int = 2) -> DataFrame:
    """(rank, left, right, n) of the merges, from (word, n); left and right in hex."""
    spark = counted.sparkSession
    # a symbol has the number of its bytes, whichever merges make it
    hexes = [f"{i:02X}" for i in range(256)]
    number = {h: i for i, h in enumerate(hexes)}
    counted = counted.filter("word IS NOT NULL").select(F.col("word").cast("binary").alias("word"), F.col("n").cast("long").alias("n"))
    state = materialised(counted.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(_blocks, BLOCK), "words")
    count = {(left, right): by for _, left, right, by in _summed(state.mapInArrow(_first, CHANGE))}
    told = lambda p: (hexes[p[0]], hexes[p[1]])
    best = lambda k: nsmallest(k, count, key=lambda p: (-count[p], told(p)))
    found: list[tuple[int, str, str, int]] = []
    pending: list[tuple[int, int, int]] = []
    while len(found) < merges:
        tried = []
        for p in best(min(TRIED, merges - len(found))):
            if count[p] >= least:
                made = "".join(told(p))
                if made not in number:
                    number[made] = len(hexes)
                    hexes.append(made)
                tried.append((*p, number[made]))
        if not tried:
            break
        for (left, right, new), changes in zip(tried, _changes(state, pending, tried), strict=True):
            pair = (left, right)
            if best(1) != [pair]:
                break
            found.append((len(found), *told(pair), count[pair]))
            pending.append((left, right, new))
            for p, by in changes.items():
                count[p] = count.get(p, 0) + by
            count = {p: n for p, n in count.items() if n}
            if pair in count and left != right:
                raise ValueError(f"merge {told(pair)} left some of its pairs")
        if len(pending) >= WRITE:
            state, pending = _written(state, pending), []
    return spark.createDataFrame(found, MERGES)


def _as_text(symbol: Column) -> Column:
    """A symbol's bytes as text; of bytes that are no whole characters, \\x and the hex."""
    text = F.unhex(symbol).cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.concat(F.lit("\\x"), symbol))


def segmented(df: DataFrame, word: str, merges: DataFrame, out: str = "symbols") -> DataFrame:
    """df with the symbols of a word as text, in order, after all merges by rank. A merge is a step, so there may be some thousand of them."""
    rules = [(r["left"], r["right"]) for r in merges.orderBy("rank").collect()]
    made = merged(symbols(F.col(word)), rules)
    parts = F.filter(F.split(made, "[<>]+", -1), lambda x: x != "")
    return df.withColumn(out, F.transform(parts, _as_text))


def is_merged(symbol: Column) -> Column:
    """Whether a symbol as text is of more than one byte."""
    return (F.octet_length(symbol) > 1) & ~F.regexp_like(symbol, F.lit(r"^\\x..$"))


def dictionary(counted: DataFrame, merges: DataFrame) -> DataFrame:
    """(symbol, uses, places) of merged symbols as they stand in the words after all merges; they are counted in hex, and of these each is made text once."""
    rules = [(r["left"], r["right"]) for r in merges.orderBy("rank").collect()]
    parts = F.filter(F.split(merged(symbols(F.col("word")), rules), "[<>]+", -1), lambda x: F.length(x) > 2)
    each = counted.filter("word IS NOT NULL").select("n", F.explode(parts).alias("hex")).groupBy("hex").agg(F.sum("n").alias("uses"), F.count("*").alias("places"))
    told = each.select(_as_text(F.col("hex")).alias("symbol"), "uses", "places").filter(is_merged(F.col("symbol")))
    return told.groupBy("symbol").agg(F.sum("uses").alias("uses"), F.sum("places").alias("places"))
