"""Documents to packed training sequences, in five stages.

Every stage works on all that its predecessor kept; all but the last return the
columns of documents, further ones included, whatever their names. A decision
falls on rows, known by id and text: null ids are ids like others, rows that
share an id are decided one by one, a null text is an empty one, and an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import dedup, langid, mixing, nearcopies, packing, simhash
from tracewright.llm.common import cut
from tracewright.llm.graph import components

#: A document goes when no language is found, or its probability is less.
LEAST_SCORE = 0.4
#: Groups of copies that are broadcast at most; with more, their filter picks the rows that are joined to them.
BROADCAST = 100_000


def with_key(docs: DataFrame, digest: Column) -> DataFrame:
    """(row, digest, id) of every row: its columns lie in a struct, where no name can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), digest.alias("digest"), F.col("doc_id").alias("id"))


def staying(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of keyed that stay, of groups (digest, keeps, kept_id, times).

    A digest that no group names stays; of others a row stays where the group
    keeps that digest and its id is kept_id. Where times rows have that digest and
    id, the least of them by its columns stays.
    """
    groups = cut(groups, "groups")
    found = groups.agg(F.count("*").alias("n"), F.max("times").alias("times")).first()
    if not found["n"]:
        return keyed.select("row.*")
    if found["n"] <= BROADCAST:
        decided, rest = keyed.join(F.broadcast(groups), "digest", "left"), None
    else:
        bits = dedup.filter_bits(found["n"])
        seen = dedup.probed(keyed, cut(dedup.digest_filter(groups, bits), "filter"), bits)
        decided, rest = seen.filter("maybe").join(groups, "digest", "left"), seen.filter("NOT maybe").select("row.*")
    stay = decided.filter(F.col("times").isNull() | (F.col("keeps") & F.col("id").eqNullSafe(F.col("kept_id"))))
    kept = stay.filter(F.coalesce("times", F.lit(1)) == 1).select("row.*")
    if found["times"] > 1:
        kept = kept.unionByName(stay.filter("times > 1").groupBy("digest").agg(F.min("row").alias("row")).select("row.*"))
    return kept if rest is None else kept.unionByName(rest)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or whose language stays in doubt, go. Repeated rows stay or go together; ties of languages go to the first by name."""
    return langid.identify(docs, langid.fit(docs), reject_below=LEAST_SCORE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: of the largest id, null ids losing, and of rows repeated with that id the least by its columns. Null and empty texts are one text."""
    found = dedup.deduplicate(docs).filter("kept AND group_size > 1").groupBy(F.unhex("text_sha256").alias("digest"), F.col("keep_id").alias("kept_id"))
    groups = found.agg(F.count("*").alias("times")).select("digest", F.lit(True).alias("keeps"), "kept_id", "times")
    return staying(with_key(docs, dedup.sha256_digest(dedup.normalised(F.col("text")))), groups)


def text_digest() -> Column:
    return dedup.sha256_digest(dedup.normalised(F.col("text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose sets of five-word shingles are alike by 0.8 or more the row with the smallest id stays.

    Candidates are the components of the SimHash popcount join, at four bits or
    fewer, and, since fingerprints are farther apart at a similarity of 0.8 (see
    the README), the cells of MinHash bands; both are held to the similarity by
    their whole sets of shingles. Nodes are known by 64 bits,
    decisions fall on SHA-256 digests: of texts that collide in those bits one is
    the node, the others stay. Null ids lose to others, ties go to the smaller key of the text, then to the
    least row by its columns. Texts without words (null too) are near copies of
    each other; equal texts are one node of a component.
    """
    keyed = docs.select(nearcopies.text_key(F.col("text")).alias("key"), text_digest().alias("digest"), "doc_id", "text")
    alike = simhash.near_duplicates(keyed, doc_id="key").select(F.col("doc_id").alias("key"), F.xxhash64(F.lit("simhash"), "component_id").alias("cell")).distinct()
    roots = cut(components(cut(nearcopies.links(keyed.select("key", "text"), also=cut(alike, "simhash")), "links")), "components")
    texts = keyed.groupBy("key", "digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("least"), F.count("*").alias("n"))
    rows = texts.groupBy("key").agg(F.min(F.struct("digest", "least", "n")).alias("text")).select("key", "text.*")
    firsts = keyed.groupBy("digest", "doc_id").agg(F.count("*").alias("times"))
    nodes = cut(rows.join(roots, F.col("key") == F.col("node"), "left").select("key", "digest", "least", "n", F.coalesce("root", "key").alias("root")), "nodes")
    groups = nodes.groupBy("root").agg(F.min(F.struct("least.no_id", "least.doc_id", "key")).alias("first"), F.sum("n").alias("n")).filter("n > 1")
    chosen = nodes.join(groups.select("root", "first"), "root").select(F.col("digest").alias("d"), (F.col("key") == F.col("first.key")).alias("keeps"), F.col("first.doc_id").alias("kept_id"))
    same = (chosen["d"] == firsts["digest"]) & chosen["kept_id"].eqNullSafe(firsts["doc_id"])
    counted = chosen.join(firsts, same, "left").select(F.col("d").alias("digest"), "keeps", "kept_id", F.coalesce("times", F.lit(1).cast("long")).alias("times"))
    return staying(with_key(docs, text_digest()), counted)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: words taken by size, rounded, so whole texts alone return, and a source is off its target by a document.

    Texts without words (null too) are never taken. Rows of equal id, text and
    source share what they take. The schedule's order isn't kept: packing deals
    pieces by a hash; mixing.mix has the first slot of each row.
    """
    key = F.xxhash64("text", "source")
    taken = mixing.mix(docs.select("doc_id", "text", "source", key.alias("key")), keep=["key"])
    shared = taken.groupBy("doc_id", "key").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).filter("taken > 0")
    times = shared.select("key", F.col("doc_id").alias("kept_id"), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("times")).filter("times > 0")
    joined = with_key(docs, key).join(cut(times, "times"), (F.col("digest") == F.col("key")) & F.col("id").eqNullSafe(F.col("kept_id")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, one row each. A null or empty text is the end id alone; repeated rows and rows that share an id are packed each by itself."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", exact_dedup),
    ("near-dedup", near_dedup),
    ("mixing to target weights", mix_sources),
    ("packing", pack),
]

#: A trained network, XXH64 and a tokenizer can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage{i + 1}")
    return docs
