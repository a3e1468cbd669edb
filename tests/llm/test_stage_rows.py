"""Stages of the pipeline decide on rows: null, repeated and shared ids."""

import collections
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tracewright.llm import langid, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (None, "no id at all here", "fr", "c", 1), (None, "the same words", "en", "a", 1), (3, "The SAME words", "en", "a", 1), (4, "twice the same row", "en", "a", 1), (4, "twice the same row", "de", "a", 1),
    (5, "shared text of two", "en", "b", 1), (6, "shared text of two", "en", "b", 1), (5, "only five has this one", "en", "b", 1), (None, "nobody has an id", "en", "b", 1), (None, "nobody has an id", "en", "b", 1), (7, None, "en", None, 0), (8, "", "en", "a", 0),
]


def test_exact_dedup_decides_on_rows(spark):
    got = [tuple(r) for r in pipeline.exact_dedup(spark, spark.createDataFrame(ROWS, SCHEMA), "").collect()]
    want = [ROWS[i] for i in (0, 2, 4, 6, 7, 8, 11)]
    assert collections.Counter(got) == collections.Counter(want)


def test_near_dedup_keeps_null_ids(spark):
    rows = [ROWS[i] for i in (0, 2, 4, 6, 7, 8, 11)]
    got = [tuple(r) for r in pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    assert collections.Counter(got) == collections.Counter(rows)


def test_mix_takes_rows_by_themselves(spark):
    words = lambda n, w: " ".join([w] * n)
    rows = [(None, words(30, "a"), "en", "a", 1), (1, words(40, "b"), "en", "a", 1), (1, words(7, "c"), "en", "b", 1), (2, words(900, "d"), "en", "b", 1), (None, words(50, "e"), "en", None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = collections.Counter(r["text"] for r in pipeline.mix_sources(spark, df, "").collect())
    sizes = {len(t.split()): t for _, t, *_ in rows}
    want = collections.Counter({sizes[r["size"]]: int(r["taken"] / r["size"] + 0.5) for r in mixing.mix(df).collect()})
    assert got == +want and got[rows[0][1]] > 0


CLASH = ["key", "digest", "id", "row", "times", "maybe", "n", "root", "keeps", "kept_id", "size", "h"]


@pytest.mark.parametrize("most", [pipeline.BROADCAST, 0])
def test_stages_on_an_awkward_table(spark, monkeypatch, most):
    """Null and shared ids, null, empty and very long texts, repeated rows, clashing columns; groups broadcast or joined through their filter."""
    monkeypatch.setattr(pipeline, "BROADCAST", most)
    words = [f"w{i}" for i in range(100)]
    near = [" ".join(words[:50] + ["x"] + words[51:]), " ".join(words)]
    rows = [*ROWS, (11, near[0], "en", "a", 1), (12, near[1], "en", "a", 1), (12, near[1], "en", "a", 1), (None, near[1] + " end", "en", "b", 1), (13, "word " * 30_000, "en", "b", 1), (14, "x" * 70_000, "en", "b", 1), (15, " \t ", "en", "c", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for i, c in enumerate(CLASH):
        df = df.withColumn(c, F.lit(i))
    near_kept = pipeline.near_dedup(spark, df, "")
    got = collections.Counter(tuple(r)[:5] for r in near_kept.collect())
    assert near_kept.columns == df.columns and all(tuple(r)[5:] == tuple(range(len(CLASH))) for r in near_kept.collect())
    # of equal texts (null, empty, white space: no words) and near copies the smallest id, one row
    assert got == collections.Counter([ROWS[0], ROWS[2], min(ROWS[3:5]), ROWS[5], ROWS[7], ROWS[8], ROWS[10], rows[12], rows[16], rows[17]])
    exact = pipeline.exact_dedup(spark, df, "")
    got = collections.Counter(tuple(r)[:5] for r in exact.collect())
    assert exact.columns == df.columns
    assert got == collections.Counter([ROWS[0], ROWS[2], min(ROWS[3:5]), ROWS[6], ROWS[7], ROWS[8], ROWS[11], *rows[12:14], *rows[15:]])
    mixed = pipeline.mix_sources(spark, df, "")
    assert mixed.columns == df.columns and all(r["text"] and r["text"].split() for r in mixed.collect())
    lettered = pipeline.identify_language(spark, df, "")
    assert lettered.columns == df.columns and not {r["doc_id"] for r in lettered.collect()} & {7, 8, 15}
    tokens = collections.defaultdict(set)
    for r in pipeline.pack(spark, df, "").collect():
        tokens[r["doc_id"]].add(r["doc_tokens"])
    assert set(tokens) == {r[0] for r in rows} and tokens[7] == tokens[8] == tokens[15] == {1}


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_sample_of_rows_that_share_an_id_and_of_long_texts(spark):
    """A label whose rows all share one id is learned like others, and no label gives more than its bound."""
    ids = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5]
    rows = [(ids[0], f"one of many {i} texts " * 9, "aa") for i in range(900)] + [(ids[i % 40], f"another text {i}", "bb") for i in range(100)] + [(ids[1], "long " * 50_000, "cc"), (None, "no id", "dd"), (ids[2], None, "ee")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = collections.Counter(label for _, label in langid.labelled_sample(docs, per_label=70))
    assert got == {"aa": 70, "bb": 70, "cc": 1}
    assert sorted(langid.labelled_sample(docs, 70)) == sorted(langid.labelled_sample(docs.repartition(2), 70))
    assert max(len(t) for t, _ in langid.labelled_sample(docs, 70)) == langid.SAMPLE_CHARS
