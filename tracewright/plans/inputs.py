"""Tables in the shape of puzzle corpora and model outputs, derived from the given ones.

Each has a Spark form and SQL of the same columns for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model output for each document: a box, several, an unclosed one, a brace in it, a phrase, a number or nothing."""
    d, ans = table(spark, sf_dir, "documents"), (F.col("doc_id") % 97).cast("string")
    k = F.col("doc_id") % 8
    body = F.coalesce(F.col("text"), F.lit(""))
    forms = [
        F.concat(body, F.lit("\nso \\boxed{"), ans, F.lit("}")),
        F.concat(F.lit("\\boxed{"), (F.col("doc_id") % 97 + 3).cast("string"), F.lit("} no, \\boxed{"), ans, F.lit("} done\n"), body),
        F.concat(body, F.lit("\\boxed{} then \\boxed{"), ans),
        F.concat(F.lit("\\boxed{"), ans, F.lit("}} end")),
        F.concat(F.lit("The final answer is: "), ans, F.lit("\nbye")),
        F.concat(F.lit("steps\nFinal answer： "), ans, F.lit("  ")),
        F.concat(F.lit("from 12.5 we get "), ans, F.lit(" units")),
        F.concat(F.lit("<think>no idea</think>\n  nothing at all \n\n")),
    ]
    out = forms[7]
    for i in range(6, -1, -1):
        out = F.when(k == i, forms[i]).otherwise(out)
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("category"), "lang", ans.alias("answer"), out.alias("output"))


OUTPUTS = r"""
    SELECT doc_id AS id, source AS category, lang, CAST(doc_id % 97 AS VARCHAR) AS answer,
    CASE doc_id % 8
        WHEN 0 THEN coalesce(text, '') || chr(10) || 'so \boxed{' || (doc_id % 97) || '}'
        WHEN 1 THEN '\boxed{' || (doc_id % 97 + 3) || '} no, \boxed{' || (doc_id % 97) || '} done' || chr(10) || coalesce(text, '')
        WHEN 2 THEN coalesce(text, '') || '\boxed{} then \boxed{' || (doc_id % 97)
        WHEN 3 THEN '\boxed{' || (doc_id % 97) || '}} end'
        WHEN 4 THEN 'The final answer is: ' || (doc_id % 97) || chr(10) || 'bye'
        WHEN 5 THEN 'steps' || chr(10) || 'Final answer： ' || (doc_id % 97) || '  '
        WHEN 6 THEN 'from 12.5 we get ' || (doc_id % 97) || ' units'
        ELSE '<think>no idea</think>' || chr(10) || '  nothing at all ' || chr(10) || chr(10) END AS output
    FROM documents
"""

#: final_answer of OUTPUTS, for use in other queries: (id, category, lang, answer, output, predicted).
PREDICTED = rf"""
    SELECT *, CASE
        WHEN contains(output, '\boxed{{') THEN coalesce(
            list_filter(boxes, lambda x: x <> '')[-1], boxes[-1])
        ELSE coalesce(
            trim(regexp_extract_all(output, '(?i)The final answer is:\s*([^\n]+)', 1)[-1]),
            trim(regexp_extract_all(output, '(?i)Final answer is:\s*([^\n]+)', 1)[-1]),
            trim(regexp_extract_all(output, '(?i)Final answer\s*[:：]\s*([^\n]+)', 1)[-1]),
            regexp_extract_all(output, '-?\d+(?:\.\d+)?')[-1],
            list_filter(list_transform(string_split(output, chr(10)), lambda x: trim(x)), lambda x: x <> '')[-1],
            'NOT_FOUND') END AS predicted
    FROM (SELECT *, list_transform(string_split(output, '\boxed{{')[2:], lambda x: regexp_replace(
            CASE WHEN contains(x, '}}') THEN regexp_extract(x, '^(.*)\}}', 1, 's') ELSE x END, '^\s+|\s+$', '', 'g')) AS boxes FROM ({OUTPUTS}))
"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus rows, every field but the id a string."""
    d = table(spark, sf_dir, "documents")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("category"), F.col("lang").alias("label"), F.concat(F.lit("trace "), (F.col("doc_id") % 50).cast("string")).alias("solver_cot"),
        F.when(F.col("doc_id") % 3 == 0, "gold").otherwise("model").alias("origin"), (F.col("doc_id") % 4).cast("string").alias("oversampling"), F.coalesce(words, F.lit(0)).cast("string").alias("token_length"),
        F.when(F.col("doc_id") % 5 == 0, "False").otherwise("True").alias("gt_match"),
    )


CORPUS = r"""
    SELECT doc_id AS id, source AS category, lang AS label, 'trace ' || (doc_id % 50) AS solver_cot,
        CASE WHEN doc_id % 3 = 0 THEN 'gold' ELSE 'model' END AS origin, CAST(doc_id % 4 AS VARCHAR) AS oversampling,
        CAST(coalesce(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')), 0) AS VARCHAR) AS token_length,
        CASE WHEN doc_id % 5 = 0 THEN 'False' ELSE 'True' END AS gt_match
    FROM documents
"""


def equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equation examples: puzzle, example number, operands, sign and result, from order lines; the variant differs by order."""
    l = table(spark, sf_dir, "lineitem")
    a, b = (F.col("l_partkey") % 90 + 10).cast("long"), (F.col("l_suppkey") % 90 + 10).cast("long")
    v = F.col("l_orderkey") % 6
    out = F.when(v == 0, a * b).when(v == 1, a + b).when(v == 2, F.abs(a - b)).when(v == 3, a * b + 1).when(v == 4, a - b).otherwise(a + b - 1)
    sign = F.element_at(F.array(*map(F.lit, "*+-$#&")), (v + 1).cast("int"))
    return l.select(F.col("l_orderkey").alias("puzzle"), F.col("l_linenumber").alias("ex"), a.alias("a"), sign.alias("op"), b.alias("b"), out.cast("long").alias("out"))


EQUATIONS = """
    SELECT l_orderkey AS puzzle, l_linenumber AS ex, a, substr('*+-$#&', CAST(v AS INT) + 1, 1) AS op, b,
        CASE v WHEN 0 THEN a * b WHEN 1 THEN a + b WHEN 2 THEN abs(a - b) WHEN 3 THEN a * b + 1 WHEN 4 THEN a - b ELSE a + b - 1 END AS out
    FROM (SELECT *, CAST(l_partkey % 90 + 10 AS BIGINT) AS a, CAST(l_suppkey % 90 + 10 AS BIGINT) AS b, l_orderkey % 6 AS v FROM lineitem)
"""


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8-bit examples: puzzle, example number, input and output byte; a rotation by the puzzle's number mod 7 + 1."""
    l = table(spark, sf_dir, "lineitem")
    k, x = (F.col("l_orderkey") % 7 + 1).cast("int"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 256).cast("int")
    y = F.expr("shiftleft(x, k) | shiftright(x, 8 - k)").bitwiseAND(F.lit(255))
    return l.select(F.col("l_orderkey").alias("puzzle"), F.col("l_linenumber").alias("ex"), k.alias("k"), x.alias("x")).withColumn("y", y).drop("k")


BITS = """
    SELECT puzzle, ex, x, ((x << k) | (x >> (8 - k))) & 255 AS y FROM (
        SELECT l_orderkey AS puzzle, l_linenumber AS ex, CAST(l_orderkey % 7 + 1 AS INT) AS k, CAST((l_partkey * 7 + l_linenumber) % 256 AS INT) AS x FROM lineitem)
"""
