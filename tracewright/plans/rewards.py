"""Rewards (R1-R12) of completions derived from documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.num import verify
from tracewright.functions.text import first_box
from tracewright.operators import rewards as ops
from tracewright.plans.evaluation import VERIFY
from tracewright.plans.inputs import table
from tracewright.plans.registry import ORACLE_SQL, query

#: A completion for each order: parts of a trace that are there or not by the digits of its key.
LINES = [
    (2, "We need to find the rule.", "Hello."),
    (3, "Prior knowledge for this kind of question:\n1. a\n2. b\n3. c\n4. d\n5. e\n6. f", "No prior."),
    (5, "Now start to traverse the solution tree, reading order = [rightward, leftward]:", "tree"),
    (2, "§1 reading rightward:\n§1.1 writing equations:\n§1.4 done", "reading"),
    (4, "~add and ~sub, lock f = a+b, then lock g = |a-b|", "~div, lock f = a/b, LHS ∈ set"),
    (3, "  Conclusion of step §1: {f = a+b, g = unknown}, 1 of 2 resolved. Need to try reading leftward.\n§2 reading leftward:", "  Conclusion of step §1: {f = a+b, g = a-b}, 2 of 2 resolved. This is the answer."),
    (7, "  Summary: Confirm reading order = rightward, f = a+b", "  Summary: Confirm reading order = upward, f = a+b"),
    (5, "Now solve the QUERY f: map the digits back to symbols", "Now guess"),
]


def dealt_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of orders, dealt out before their texts are made: to so many tasks by number, since of keys alone, which are small, Spark would make one task again."""
    return table(spark, sf_dir, "orders").select("o_orderkey").repartition(4 * spark.sparkContext.defaultParallelism, "o_orderkey")


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    lines = [F.when(k % m == 0, F.lit(b)).otherwise(F.lit(a)) for m, a, b in LINES]
    gold = (k % 89).cast("string")
    end = F.when(k % 6 == 0, F.lit("no box")).when(k % 6 == 1, F.concat(F.lit("\\boxed{"), gold, F.lit("}<|im_end|>"))).when(k % 6 == 2, F.concat(F.lit("\\boxed{unknown} \\boxed{"), gold, F.lit("}"))).otherwise(F.concat(F.lit("I will now return the answer in \\boxed{}, the answer is \n\\boxed{"), (k % 89 + (k % 6 == 5).cast("int") * 40).cast("string"), F.lit("}")))
    category = F.when(k % 2 == 0, "cryptarithm_deduce").otherwise("equation_numeric_deduce")
    return dealt_keys(spark, sf_dir).select(k.alias("id"), category.alias("category"), gold.alias("gold"), F.lit("0123456789AB").alias("pool"), F.concat_ws("\n", *lines, end).alias("text"), (k % 3000).alias("tokens"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_ORACLE_LINES = " || chr(10) || ".join(f"CASE WHEN id % {m} = 0 THEN {_q(b)} ELSE {_q(a)} END" for m, a, b in LINES)
COMPLETIONS = rf"""SELECT *, {_ORACLE_LINES} || chr(10) || CASE id % 6 WHEN 0 THEN 'no box' WHEN 1 THEN '\boxed{{' || gold || '}}<|im_end|>' WHEN 2 THEN '\boxed{{unknown}} \boxed{{' || gold || '}}'
    ELSE 'I will now return the answer in \boxed{{}}, the answer is ' || chr(10) || '\boxed{{' || (id % 89 + CAST(id % 6 = 5 AS INT) * 40) || '}}' END AS text
    FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'cryptarithm_deduce' ELSE 'equation_numeric_deduce' END AS category, CAST(o_orderkey % 89 AS VARCHAR) AS gold, '0123456789AB' AS pool, o_orderkey % 3000 AS tokens FROM orders)"""


def ids(df: DataFrame, score) -> DataFrame:
    return df.select("id", score.alias("score"))


@query("R1_final_answer", rf"""SELECT id, CASE WHEN len(b) = 0 THEN -2.0 ELSE round(least(3.5, CASE WHEN {VERIFY.format(g='gold', p='ans')} THEN 2.5 ELSE -1.5 END
    + CASE WHEN category = 'cryptarithm_deduce' THEN CASE WHEN regexp_full_match(ans, '[0-9AB -]*') THEN 0.5 ELSE -0.5 END ELSE CASE WHEN regexp_full_match(ans, '-?\d+') THEN 0.5 ELSE -0.5 END END
    + CASE WHEN contains(lower(ans), 'unknown') THEN -1.0 ELSE 0.5 END + CASE WHEN len(b) = 1 THEN 0.2 ELSE -0.2 END), 6) END::DOUBLE AS score FROM (SELECT *, b[-1] AS ans FROM (SELECT *, regexp_extract_all(text, '\\boxed\{{([^}}]+)\}}', 1) AS b FROM ({COMPLETIONS})))""")
def final_answer(spark, sf_dir):
    return ids(completions(spark, sf_dir), ops.final_answer(F.col("text"), F.col("gold"), F.col("category"), F.col("pool")))


@query("R2_conclusion_semantic", f"""SELECT id, round(0.5 + CASE WHEN id % 3 = 0 THEN 0.4 ELSE -0.8 END + CASE WHEN id % 7 = 0 OR id % 2 = 0 THEN -0.4 ELSE 0.4 END
    + CASE WHEN id % 3 = 0 THEN 0.0 ELSE 0.3 END, 6)::DOUBLE AS score FROM ({COMPLETIONS})""")
def conclusion_semantic(spark, sf_dir):
    return ids(completions(spark, sf_dir), ops.conclusion_semantic(F.col("text"), F.col("category")))


@query("R3_solve_query_remap", f"""SELECT id, round(CASE WHEN id % 5 = 0 THEN -0.3 ELSE 0.3 END + CASE WHEN id % 6 IN (3, 4, 5) THEN 0.5 ELSE -0.5 END + CASE WHEN id % 2 = 1 THEN 0.0 WHEN id % 5 = 0 THEN -0.5 ELSE 0.2 END, 6)::DOUBLE AS score FROM ({COMPLETIONS})""")
def solve_query_remap(spark, sf_dir):
    return ids(completions(spark, sf_dir), ops.solve_query_remap(F.col("text"), F.col("category")))


@query("R4_skeleton_alignment", f"""SELECT id, round(CASE WHEN id % 2 = 0 THEN -0.2 ELSE 0.2 END + CASE WHEN id % 3 = 0 THEN -0.3 ELSE 0.3 END + CASE WHEN id % 5 = 0 THEN -0.2 ELSE 0.2 END + CASE WHEN id % 2 = 0 THEN -0.2 ELSE 0.4 END + CASE WHEN id % 2 = 0 THEN -0.1 ELSE 0.0 END + 0.2, 6)::DOUBLE AS score FROM ({COMPLETIONS})""")
def skeleton_alignment(spark, sf_dir):
    return ids(completions(spark, sf_dir), ops.skeleton_alignment(F.col("text"), F.col("category"), F.lit(4)))


@query("R5_closed_vocabulary", f"""SELECT id, round(CASE WHEN id % 4 = 0 THEN -0.1 - 0.1 - 0.2 ELSE 0.9 END + CASE WHEN id % 2 = 1 OR id % 3 <> 0 THEN 0.3 ELSE -0.3 END, 6)::DOUBLE AS score FROM ({COMPLETIONS})""")
def closed_vocabulary(spark, sf_dir):
    return ids(completions(spark, sf_dir), ops.closed_vocabulary(F.col("text")))


@query("R6_termination", f"""SELECT id, round(CASE WHEN id % 6 IN (0, 1) THEN -1.0 ELSE 0.4 END + CASE WHEN tokens < 2000 THEN 0.2 ELSE -0.3 END + CASE WHEN id % 6 = 0 THEN -0.2 ELSE 0.2 END, 6)::DOUBLE AS score FROM ({COMPLETIONS})""")
def termination(spark, sf_dir):
    score = ops.termination(F.col("text"), F.col("tokens"), F.lit(2000))
    return ids(completions(spark, sf_dir), score)


@query("R7_solver_alignment")
def solver_alignment(spark, sf_dir):
    gold = F.lit("Conclusion of step §1: {f = a+b, g = a-b}, 2 of 2 resolved.")
    return ids(completions(spark, sf_dir), ops.scored(ops.solver_alignment, F.col("text"), gold))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with two examples and a query, and completions that read them with a fault by a hash of the key: none, a wrong sign, signs not split, a line left out, a line twice, an operator named wrongly."""
    k = F.col("o_orderkey")
    fault = F.pmod(F.conv(F.substring(F.md5(k.cast("string").cast("binary")), 1, 6), 16, 10).cast("long"), F.lit(6))
    a, b = (k % 90 + 10).cast("string"), (k % 80 + 11).cast("string")
    prompt = F.concat(F.lit("examples:\n"), a, F.lit("+"), b, F.lit(" = 77\n"), b, F.lit("*"), a, F.lit("= 5 \nNow, determine the result for: "), b, F.lit("+"), a)
    spaced = lambda s: F.array_join(F.split(s, ""), " ")
    first = F.concat(a, F.when(fault == 1, "-").otherwise("+"), b, F.lit("=77"))
    first = F.when(fault == 2, first).otherwise(spaced(first))
    second = F.concat(F.lit("EX2 "), b, F.lit("*"), a, F.lit("=5 becomes "), spaced(F.concat(b, F.when(fault == 5, "*").otherwise("g"), a, F.lit("=5"))))
    lines = [
        F.lit("read each equation one symbol"), F.when(fault == 5, "* -> f").otherwise("+ -> f"), F.lit("* -> g"), F.concat(F.lit("EX1 "), a, F.lit("+"), b, F.lit("=77 becomes "), first),
        F.when(fault != 3, second), F.when(fault == 4, F.concat(F.lit("EX1 "), b, F.lit(" becomes 1"))), F.concat(F.lit("QUERY "), b, F.lit("+"), a, F.lit(" becomes "), spaced(F.concat(b, F.lit("f"), a))),
    ]
    return dealt_keys(spark, sf_dir).select(k.alias("id"), fault.alias("fault"), prompt.alias("prompt"), F.concat_ws("\n", *lines).alias("text"))


FAULT = "CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 6)) AS BIGINT) % 6"


@query("R8_crypt_parse", f"SELECT o_orderkey AS id, round(CASE {FAULT} WHEN 1 THEN 0.5 - 0.45 WHEN 2 THEN 0.5 - 0.45 WHEN 3 THEN 0.5 + 1/3 - 0.15 WHEN 5 THEN 2/3 - 0.15 + 0.2 - 0.3 ELSE 0.5 + 1/3 - 0.3 END, 6)::DOUBLE AS score FROM orders")
def crypt_parse(spark, sf_dir):
    return ids(parsed(spark, sf_dir), ops.crypt_parse(F.col("prompt"), F.col("text")))


@query("R9_equation_parse", f"SELECT o_orderkey AS id, round(CASE {FAULT} WHEN 1 THEN 0.3 + 0.05 + 0.2 WHEN 3 THEN 0.3 + 0.05 + 0.2 WHEN 5 THEN -0.3 + 0.5 - 0.2 ELSE 1 END, 6)::DOUBLE AS score FROM orders")
def equation_parse(spark, sf_dir):
    return ids(parsed(spark, sf_dir), ops.equation_parse(F.col("prompt"), F.col("text")))


#: Each reward's own SQL, side by side; the prompt is one that no completion reads.
STACKED = dict(zip("final_answer conclusion query skeleton vocab termination".split(), [f"R{i}" for i in range(1, 7)], strict=True))
R10 = "SELECT o.id, parse, {cols}, round(parse + {total}, 6)::DOUBLE AS score FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN -0.9 ELSE -0.7 END::DOUBLE AS parse FROM orders) o {joins}".format(
    cols=", ".join(f"{r}.score AS {n}" for n, r in STACKED.items()), total=" + ".join(f"{r}.score" for r in STACKED.values()),
    joins=" ".join(f"JOIN ({next(sql for name, sql in ORACLE_SQL.items() if name.startswith(r + '_'))}) {r} ON o.id = {r}.id" for r in STACKED.values()),
)


@query("R10_stacks", R10)
def stacks(spark, sf_dir):
    """Every completion under the seven rewards of its category's stack, and their sum; each reward is planned once."""
    c = completions(spark, sf_dir).withColumn("prompt", F.concat(F.lit("examples:\n12+34 = 46\nNow, determine the result for: 56+78")))
    row = {x: F.col(x) for x in ("text", "category", "gold", "pool", "tokens", "prompt")} | {"examples": F.lit(4), "limit": F.lit(2000)}
    found = ops.masked(F.col("category"), ops.stacks(row))
    each = c.select("id", *(score.alias(name) for name, score in found.items()))
    return each.withColumn("score", F.round(sum((F.col(n) for n in found), F.lit(0.0)), 6))


@query("R11_scale", f"SELECT id, round(CASE WHEN id % 3 = 0 THEN s ELSE s * (id % 3) END, 6)::DOUBLE AS score FROM (SELECT id, CASE WHEN id % 5 = 0 THEN -0.3 ELSE 0.3 END AS s FROM ({COMPLETIONS}))")
def scale(spark, sf_dir):
    c = completions(spark, sf_dir)
    s = F.when(F.col("id") % 5 == 0, F.lit(-0.3)).otherwise(F.lit(0.3))
    weight = F.when(F.col("id") % 3 == 0, F.lit("n/a")).otherwise((F.col("id") % 3).cast("string"))
    return ids(c, F.round(ops.scale(s, weight), 6))


@query("R12_cosine", rf"""SELECT id, round(CASE WHEN box IS NULL THEN -0.5 * share WHEN {VERIFY.format(g='gold', p='box')} THEN 0.1 + 0.9 * wave ELSE -0.1 - 0.9 * (1 - wave) END, 6)::DOUBLE AS score FROM
    (SELECT *, (1 + cos(pi() * share)) / 2 AS wave FROM (SELECT *, least(length(text) / 2000.0, 1.0) AS share, nullif(regexp_extract(text, '\\?boxed\{{(.*?)\}}', 1, 's'), '') AS box FROM ({COMPLETIONS})))""")
def cosine(spark, sf_dir):
    box = first_box(F.col("text"))
    c = completions(spark, sf_dir).withColumn("box", box)
    return ids(c, ops.cosine_length(F.col("text"), F.col("box"), F.coalesce(verify(F.col("gold"), F.col("box")), F.lit(False)), 2000))


@query("R12_reasoning_quality", rf"""SELECT id, round(CASE WHEN regexp_matches(lower(text), 'step\s*\d|example\s*\d|first|then|therefore|thus') THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(text, '[=×÷+\-*/^]') THEN 0.2 ELSE 0 END + CASE WHEN instr(text, '\boxed') > 101 THEN 0.2 ELSE 0 END
    + CASE WHEN len(w) > 10 AND len(list_distinct(w)) / len(w) > 0.3 THEN 0.3 ELSE 0 END, 6)::DOUBLE AS score FROM (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM ({COMPLETIONS}))""")
def reasoning_quality(spark, sf_dir):
    return ids(completions(spark, sf_dir), ops.reasoning_quality(F.col("text")))
