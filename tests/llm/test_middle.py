"""Fill-in-the-middle against a plain loop over code points, and its grammars."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tracewright.llm import middle

SCHEMA = "doc_id long, text string"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def slow(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    p, m, s = f"<P>{text[:a]}", f"<M>{text[a:b]}", f"<S>{text[b:]}"
    return doc_id, n, "spm" if h4 % 100 < 20 else "psm", a, b - a, sha(s + p + m if h4 % 100 < 20 else p + s + m), sha(text)


def test_equals_a_plain_loop(spark):
    rng = random.Random(13)
    alphabet = ["a", "b", " ", "\n", "é", "日", "𝔘", "👩‍💻", "é", "<", "P", ">", "<P", "|<S", "\r\n", "$1", "\\E", "\x00", " "]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))) for i in range(400)]
    rows += [(None, "no id"), (None, None), (1000, None), (1001, ""), (1002, "x"), (1003, "has <M> in it"), (5, "again"), (5, "again"), (1004, "long " * 60000 + "𝔘" * 1000), (-3, "negative")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("units", F.lit(1)).withColumn("form", F.lit("clash")).withColumn("h1", F.lit(2)).withColumn("p", F.lit(3))
    got = [tuple(r) for r in middle.digests(middle.transform(docs)).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted((slow(*r) for r in rows), key=key)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_empty_table_and_columns_passed_through(spark):
    assert middle.digests(middle.transform(spark.createDataFrame([], SCHEMA))).count() == 0
    docs = spark.createDataFrame([(1, "abc", "k", 7)], "doc_id long, text string, `a.b` string, output int")
    row = middle.transform(docs, keep=["a.b"]).first()
    assert row["a.b"] == "k" and row["n"] == 3


def test_of_all_rows_the_shares_are_near_their_targets(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    forms = {r["form"]: r["count"] for r in middle.transform(docs).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 2000) < 200 and abs(forms["spm"] - 3600) < 300


@pytest.mark.parametrize(
    ("grammar", "text", "want"),
    [
        ("code point", "a𝔘\nb", ["a", "𝔘", "\n", "b"]),
        ("grapheme", "éa\r\nb", ["é", "a", "\r\n", "b"]),
        ("word", "  one two\n three", ["  ", "one ", "two\n ", "three"]),
        ("token", "ab12, (x) 7", ["ab", "12", ",", " ", "(", "x", ")", " ", "7"]),
        ("line", "a\n\nb\n", ["a\n", "\n", "b\n"]),
        ("sentence", "One. Two! 3.5 is it?\nYes", ["One. ", "Two! ", "3.5 is it?\n", "Yes"]),
    ],
)
def test_grammars(spark, grammar, text, want):
    rows = spark.createDataFrame([(text,), ("",), (None,)], "text string")
    got = [r[0] for r in rows.select(middle.units(F.col("text"), middle.GRAMMARS[grammar])).collect()]
    assert got == [want, [], []]


@pytest.mark.parametrize("grammar", list(middle.GRAMMARS))
def test_every_grammar_loses_nothing_and_is_undone(spark, grammar):
    rng = random.Random(len(grammar))
    rows = [(i, "".join(rng.choice("ab1. \n!?é,") for _ in range(rng.randrange(60)))) for i in range(200)]
    marks = middle.Sentinels("<|pre|>", "<|suf|>", "<|mid|>")
    made = middle.transform(spark.createDataFrame(rows, SCHEMA), middle.GRAMMARS[grammar], plain_from=100, spm_below=50, sentinels=marks)
    texts = dict(rows)
    for r in middle.restored(made, marks).collect():
        assert r["restored"] == texts[r["doc_id"]]
        pieces = re.split(marks.regex(), r["output"])
        assert r["form"] == "plain" and not texts[r["doc_id"]] or sorted(map(len, pieces[1:])) == sorted((r["prefix_chars"], r["middle_chars"], len(r["restored"]) - r["prefix_chars"] - r["middle_chars"]))


def test_sentinels_that_overlap_are_refused():
    with pytest.raises(ValueError, match="overlap"):
        middle.Sentinels("<P>", ">S", "<M>")
    with pytest.raises(ValueError, match="overlap"):
        middle.Sentinels("<P>", "<P>", "<M>")
