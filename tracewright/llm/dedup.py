"""Exact deduplication by a log-structured merge index, in DataFrame operations only.

Memtables, one for each task and at most MEMTABLE rows a file, flush runs of
(digest, id) sorted by digest. The runs of a generation are compacted into a
level: one row for each digest, with the smallest and the largest identifier and
the count. Two levels are merged through their filters (bitmaps of their
digests): a digest that the other level's filter doesn't have stays as it is,
and only the rest meet. Digests of more than one row are hits. Their filter
picks the rows whose bytes are read again, and a digest whose texts aren't all
the same bytes is split by text; rows that the filter doesn't have are single,
and are joined to nothing.

A filter has at most MAX_BITS bits, which is what is broadcast at most; with
more digests than that it lets more rows pass, up to all, and results are the
same. Hits of more than HOT rows, of which there are few, are broadcast, so that
no digest's rows gather in one task.

Defined cases: a null text is empty; texts are equal when their bytes are after
A-Z is lowered; of equal texts `keep` ("largest" or "smallest") names the id
that stays, null ids losing to others; rows with equal text and equal id stay
or go together; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import ascii_lower, cut

#: Rows of a file of a run; generations of runs; bits of a filter for each digest, and its largest size (32 MB).
MEMTABLE, LEVELS, BITS_EACH, MAX_BITS = 1_000_000, 2, 16, 1 << 28
BUCKET_BITS = 32768
#: A digest of more rows than this, and than a ten-thousandth of all, is hot.
HOT, HOT_SHARE = 100_000, 10_000


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256_digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def flush(docs: DataFrame, digest=sha256_digest, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Sorted runs of (digest, id), and the number of the memtable that wrote each."""
    rows = docs.select(digest(normalised(F.col(text))).alias("digest"), F.col(doc_id).alias("id"), F.spark_partition_id().alias("run"))
    return cut(rows.sortWithinPartitions("digest", "id"), "runs", **{"maxRecordsPerFile": str(MEMTABLE)})


def compact(*runs: DataFrame) -> DataFrame:
    """One row for each digest of the runs or of levels compacted before: smallest and largest id, rows."""
    parts = [r if "n" in r.columns else r.select("digest", F.col("id").alias("low"), F.col("id").alias("high"), F.lit(1).cast("long").alias("n")) for r in runs]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return merged.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))


def filter_bits(n: int) -> int:
    return min(MAX_BITS, max(BUCKET_BITS, 1 << (n * BITS_EACH - 1).bit_length()))


def digest_filter(level: DataFrame, bits: int) -> DataFrame:
    """A bitmap of the digests of a level, in rows of 4 KB."""
    at = F.pmod(F.xxhash64("digest"), F.lit(bits))
    return level.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("__bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("__bitmap"))


def probed(rows: DataFrame, bitmap: DataFrame, bits: int) -> DataFrame:
    """rows with `maybe`: whether the filter has their digest; the bitmap has at most MAX_BITS."""
    rows = rows.withColumn("__at", F.pmod(F.xxhash64("digest"), F.lit(bits)))
    joined = rows.join(F.broadcast(bitmap), F.bitmap_bucket_number("__at") == F.col("__bucket"), "left")
    byte = F.conv(F.hex(F.substring("__bitmap", (F.expr("bitmap_bit_position(__at)") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(__at) % 8 as int))")) != 0
    return joined.withColumn("maybe", F.coalesce(bit, F.lit(False))).drop("__at", "__bucket", "__bitmap")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """A level of two: digests that the other's filter doesn't have stay, and only the others are compacted."""
    sizes = [x.count() for x in (a, b)]
    if not all(sizes):
        return a if sizes[0] else b
    bits = [filter_bits(n) for n in sizes]
    a_seen = cut(probed(a, digest_filter(b, bits[1]), bits[1]), "probed")
    b_seen = cut(probed(b, digest_filter(a, bits[0]), bits[0]), "probed")
    both = a_seen.unionByName(b_seen)
    return both.filter("NOT maybe").drop("maybe").unionByName(compact(*(x.filter("maybe").drop("maybe") for x in (a_seen, b_seen))))


def index(runs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The level of all runs: generation by generation, each compacted and merged into what is there."""
    level = None
    for g in range(levels):
        new = cut(compact(runs.filter(F.col("run") % levels == g).drop("run")), "level")
        level = new if level is None else cut(merge(level, new), "level")
    return level


def deduplicate(docs: DataFrame, keep: str = "largest", digest=sha256_digest, doc_id: str = "doc_id", text: str = "text", levels: int = LEVELS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs."""
    runs = flush(docs, digest, doc_id, text)
    level = index(runs, levels)
    hits = cut(level.filter("n > 1").select("digest", F.col("high" if keep == "largest" else "low").alias("chosen"), "n"), "hits")
    row = hits.agg(F.count("*").alias("hits"), F.sum("n").alias("rows")).first()
    rows = runs.drop("run")
    if not row["hits"]:
        return _named(docs, rows.select("digest", "id", F.col("id").alias("chosen"), F.lit(1).cast("long").alias("n")), digest, doc_id, text)
    bits = filter_bits(row["hits"])
    bitmap = cut(digest_filter(hits, bits), "filter")
    # least and greatest text of a digest are combined before anything is dealt out, so copies of one text stay where they are
    norm = docs.select(F.col(doc_id).alias("id"), normalised(F.col(text)).alias("norm")).withColumn("digest", digest(F.col("norm")))
    suspects = probed(norm, bitmap, bits).filter("maybe").drop("maybe")
    checked = suspects.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"))
    bad = cut(checked.filter(F.col("least") != F.col("greatest")).select("digest"), "collisions")
    if not bad.isEmpty():
        return _split(norm, level, bad, keep)
    seen = probed(rows, bitmap, bits)
    least = max(HOT, row["rows"] // HOT_SHARE)
    hot = hits.filter(F.col("n") > least).select(F.col("digest").alias("__d"), F.col("chosen").alias("__chosen"), F.col("n").alias("__n"))
    # of hot digests there are at most HOT_SHARE
    maybe = seen.filter("maybe").join(F.broadcast(hot), F.col("digest") == F.col("__d"), "left")
    found = maybe.filter("__d IS NOT NULL").select("digest", "id", F.col("__chosen").alias("chosen"), F.col("__n").alias("n"))
    rest = maybe.filter("__d IS NULL").select("digest", "id").join(hits, "digest", "left")
    single = F.col("n").isNull()
    rest = rest.select("digest", "id", F.when(single, F.col("id")).otherwise(F.col("chosen")).alias("chosen"), F.coalesce("n", F.lit(1).cast("long")).alias("n"))
    sure = seen.filter("NOT maybe").select("digest", "id", F.col("id").alias("chosen"), F.lit(1).cast("long").alias("n"))
    return _named(docs, sure.unionByName(found).unionByName(rest), digest, doc_id, text)


def _out(df: DataFrame, sha: Column) -> DataFrame:
    return df.select(F.col("id").alias("doc_id"), F.col("chosen").alias("keep_id"), F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("chosen")).alias("kept"), sha.alias("text_sha256"))


def _named(docs: DataFrame, rows: DataFrame, digest, doc_id: str, text: str) -> DataFrame:
    """rows (digest, id, chosen, n) as the result; of another digest than SHA-256 the texts' own is found by the digest."""
    if digest is sha256_digest:
        return _out(rows, F.lower(F.hex("digest")))
    norm = normalised(F.col(text))
    names = docs.select(digest(norm).alias("digest"), F.sha2(norm.cast("binary"), 256).alias("sha")).distinct()
    return _out(rows.join(names, "digest"), F.col("sha"))


def _split(norm: DataFrame, level: DataFrame, bad: DataFrame, keep: str) -> DataFrame:
    """The result where digests collide: those are grouped by text, the others as the level has them."""
    pick = F.max if keep == "largest" else F.min
    full = norm.withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256))
    split = full.join(bad, "digest", "left_semi").groupBy("digest", "norm").agg(pick("id").alias("chosen"), F.count("*").alias("n"))
    good = level.join(bad, "digest", "left_anti").select("digest", F.col("high" if keep == "largest" else "low").alias("chosen"), "n")
    return _out(full.drop("norm").join(good, "digest"), F.col("sha")).unionByName(_out(full.join(split, ["digest", "norm"]), F.col("sha")))
