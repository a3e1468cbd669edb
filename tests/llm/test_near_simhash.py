"""The near-dedup stage takes candidates from the SimHash popcount join too."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.brute import slow_kept
from tracewright.llm import nearcopies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def some_texts():
    """400 words, the same with a word more (few bits and shingles differ), and others; texts of no words."""
    rng = random.Random(5)
    first, other = (" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(2))
    return [(1, other), (2, first + " end"), (3, first), (4, ""), (5, None), (6, other.upper())]


def test_stage_uses_simhash_components(spark, monkeypatch):
    seen = {}
    plain = nearcopies.links

    def links(docs, also=None):
        seen["cells"] = {r["key"]: r["cell"] for r in also.collect()}
        seen["keys"] = {r["text"]: r["key"] for r in docs.collect()}
        return plain(docs, also=also)

    monkeypatch.setattr(nearcopies, "links", links)
    rows = some_texts()
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    kept = sorted(r["doc_id"] for r in pipeline.near_dedup(spark, docs, "").collect())
    assert kept == [rows[i][0] for i in slow_kept(rows)] == [1, 2, 4]
    cell = lambda k: seen["cells"][seen["keys"][rows[k][1]]]
    assert cell(1) == cell(2) != cell(0)


def test_cells_from_elsewhere_are_held_to_the_similarity(spark):
    """A cell that others give leads to links where the sets are alike, and to none where they aren't."""
    rng = random.Random(6)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:100] + ["x"] * 20 + words[100:])), (3, " ".join(reversed(words)))]
    docs = spark.createDataFrame(rows, "key long, text string")
    also = docs.select("key", F.lit(9).cast("long").alias("cell"))
    pairs = {tuple(sorted(e)) for e in nearcopies.links(docs, also=also).collect()}
    assert pairs == {(1, 2)}
    low = {tuple(sorted(e)) for e in nearcopies.links(docs, 0.0, also=also).collect()}
    assert len(low) == 2  # at a similarity of nothing all meet through the cell alone
