"""The near-dedup stage of the pipeline against all pairs' shingle similarity."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.brute import slow_kept
from tracewright.llm import nearcopies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts_with_near_copies():
    """Of 100 words, one other word leaves a similarity of 0.90, two leave 0.81 and three 0.73; chains of two go further."""
    rng, rows = random.Random(11), []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(100)]
        rows.append(" ".join(words))
        for k in (1, 2, 3):
            other = words[:]
            for p in rng.sample(range(10, 90, 10), k):
                other[p] = "X"
            rows.append(" ".join(other))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("cell", "most"), [(2048, 100_000), (3, 0), (5, 100_000), (2048, 0)])
def test_near_stage_finds_copies_from_0_8(spark, monkeypatch, cell, most):
    """Clusters searched at once, by cell and by chunks; texts found by a broadcast and through a filter."""
    monkeypatch.setattr(nearcopies.links, "__defaults__", (nearcopies.LEAST, cell))
    monkeypatch.setattr(nearcopies, "BROADCAST", most)
    texts = texts_with_near_copies()
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts], SCHEMA)
    assert sorted(r["doc_id"] for r in pipeline.near_dedup(spark, df, "").collect()) == slow_kept(texts)


def test_near_stage_on_documents(spark):
    docs = pipeline.exact_dedup(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "").cache()
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert sorted(r["doc_id"] for r in pipeline.near_dedup(spark, docs, "").collect()) == [texts[i][0] for i in slow_kept(texts)]


def test_near_stage_empty(spark):
    assert pipeline.near_dedup(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_texts_that_collide_in_the_key_stay(spark, monkeypatch):
    """Of texts with one key (planted here) only the node's own copies are decided on."""
    monkeypatch.setattr(nearcopies, "text_key", lambda text: F.when(F.startswith(text, F.lit("clash")), F.lit(5).cast("long")).otherwise(F.xxhash64(text)))
    rows = [(1, "clash of one text that is long enough to have some shingles in it"), (2, "clash of another text, of words that nobody else has said so far"), (3, "a third text that stands for itself and is of other words again")]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in pipeline.near_dedup(spark, docs, "").collect()) == [1, 2, 3]
