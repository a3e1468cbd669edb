"""Extraction and matching on stated vectors."""

import pytest
from pyspark.sql import functions as F

from tracewright.functions import num, text

EXTRACT = [
    ("The answer is \\boxed{42}", "42"), ("The final answer is: 3.14", "3.14"), ("Just a number 100 in text", "100"), (None, "NOT_FOUND"), ("", "NOT_FOUND"),
    ("\\boxed{-}}", "-}"), ("\\boxed{x", "x"), ("\\boxed{} \\boxed{ }", ""), ("\\boxed{a} \\boxed{}", "a"), ("Final answer： 7", "7"), ("a\n b \n\n", "b"),
]
VERIFY = [
    ("10011000", "10011000", True), ("10011000", "10011001", False), ("24.64", "24.6401", True), ("XLVII", "xlvii", True), ("11011", "00011011", False), ("159", "158", True), ("01", "1", False), ("*53", "53", False),
    ("nan", "nan", False), ("inf", "inf", True), ("1_000", "1000", True), ("5", "5d", False), ("0.000001", "0", True), ("inf", "3", False),
]


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_final_answer(spark):
    got = values(spark, [(t,) for t, _ in EXTRACT], "t string", text.final_answer(F.col("t")))
    assert got == [w for _, w in EXTRACT]


def test_legacy_box(spark):
    got = values(spark, [("\\boxed{-}}",), ("\\boxed{x",), ("\\boxed{a} \\boxed{}",)], "t string", text.boxed_legacy(F.col("t")))
    assert got == ["-", "x", "a"]


def test_verify(spark):
    got = values(spark, [(g, p) for g, p, _ in VERIFY], "g string, p string", num.verify(F.col("g"), F.col("p")))
    assert got == [w for _, _, w in VERIFY]


def test_first_difference(spark):
    got = values(spark, [("abc", "abc"), ("abc", "abd"), ("ab", "abc"), (None, "a")], "a string, b string", text.first_difference(F.col("a"), F.col("b")))
    assert got == [-1, 2, 2, -1]


@pytest.mark.parametrize("n", [1, 4, 16])
def test_shuffle_does_not_depend_on_partitions(spark, n):
    from tracewright.operators.corpus import hash_order

    df = spark.range(200).repartition(n)
    got = [r["id"] for r in df.orderBy(hash_order(42, "id"), "id").collect()]
    assert got == [r["id"] for r in spark.range(200).coalesce(1).orderBy(hash_order(42, "id"), "id").collect()]
