"""Prompt parsing and derived features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import parse
from tracewright.plans.inputs import BITS, EQUATIONS, bits, equations, table
from tracewright.plans.registry import query

#: A prompt for each order: its equation lines, then the question.
PROMPTS = f"""SELECT puzzle, string_agg(a || op || b || ' = ' || out, chr(10) ORDER BY ex, a || op || b || ' = ' || out) || chr(10) || 'Now, determine the result for: ' || min(a) || min(op) || max(b) AS prompt FROM ({EQUATIONS}) GROUP BY puzzle"""


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = equations(spark, sf_dir).withColumn("line", F.concat("a", "op", "b", F.lit(" = "), "out"))
    g = e.groupBy("puzzle").agg(F.array_sort(F.collect_list(F.struct("ex", "line"))).alias("l"), F.min("a").alias("qa"), F.min("op").alias("qo"), F.max("b").alias("qb"))
    text = F.concat(F.array_join(F.transform("l", lambda s: s["line"]), "\n"), F.lit("\nNow, determine the result for: "), "qa", "qo", "qb")
    return g.select("puzzle", text.alias("prompt"))


EXAMPLES = f"SELECT puzzle, unnest(list_filter(string_split(prompt, chr(10)), lambda x: contains(x, '=') AND NOT starts_with(x, 'Now'))) AS line FROM ({PROMPTS})"


@query("P1_parse_prompt", f"SELECT puzzle, count(*) AS examples, count(DISTINCT trim(split_part(line, '=', 1))) AS inputs, max(question) AS question FROM (SELECT *, (SELECT trim(split_part(p.prompt, 'result for:', 2)) FROM ({PROMPTS}) p WHERE p.puzzle = e.puzzle) AS question FROM ({EXAMPLES}) e) GROUP BY puzzle")
def parse_prompt(spark, sf_dir):
    examples, question = parse.parse_prompt(F.col("prompt"))
    p = prompts(spark, sf_dir).select("puzzle", examples.alias("e"), question.alias("question"))
    return p.select("puzzle", F.size("e").cast("long").alias("examples"), F.size(F.array_distinct(F.transform("e", lambda s: s["input"]))).cast("long").alias("inputs"), "question")


@query("P2_parse_equation", f"SELECT puzzle, ex, CAST(a AS VARCHAR) AS a, op, CAST(b AS VARCHAR) AS b FROM ({EQUATIONS})")
def parse_equation(spark, sf_dir):
    e = equations(spark, sf_dir).select("puzzle", "ex", parse.parse_equation(F.concat("a", "op", "b")).alias("s"))
    return e.select("puzzle", "ex", "s.a", "s.op", "s.b")


@query("P3_symbol_letters", "SELECT id, list_distinct(string_split(p, '')).len() AS symbols, array_to_string(list_filter(list_transform(range(1, length(p) + 1), lambda i: CASE WHEN instr(p, substr(p, i, 1)) = i THEN substr(p, i, 1) END), lambda x: x IS NOT NULL), '') AS in_order FROM (SELECT p_partkey AS id, replace(p_name, ' ', '') AS p FROM part)")
def symbol_letters(spark, sf_dir):
    """Symbols in the order in which they first appear."""
    s = F.array_distinct(F.split(F.replace("p_name", F.lit(" "), F.lit("")), ""))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.size(s).cast("long").alias("symbols"), F.array_join(s, "").alias("in_order"))


@query("P4_extract_puzzle", f"SELECT puzzle, md5(split_part(prompt, chr(10) || 'Now,', 1)) AS body FROM ({PROMPTS})")
def extract_puzzle(spark, sf_dir):
    return prompts(spark, sf_dir).select("puzzle", F.md5(F.substring_index("prompt", "\nNow,", 1).cast("binary")).alias("body"))


@query("P5_parse_bits", f"SELECT puzzle, CAST(count(*) AS BIGINT) AS n, CAST(sum(x) AS BIGINT) AS x, CAST(sum(y) AS BIGINT) AS y FROM ({BITS}) GROUP BY puzzle")
def parse_bits(spark, sf_dir):
    """Examples written as `01010101 -> 10101010`, read back by a pattern with two groups."""
    byte = lambda c: F.lpad(F.bin(c), 8, "0")
    text = bits(spark, sf_dir).groupBy("puzzle").agg(F.array_join(F.collect_list(F.concat(byte("x"), F.lit(" -> "), byte("y"))), "\n").alias("t"))
    part = lambda i: F.regexp_extract_all("t", F.lit("([01]{8}) -> ([01]{8})"), F.lit(i))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, s: acc + F.conv(s, 2, 10).cast("long"))
    return text.select("puzzle", F.size(part(1)).cast("long").alias("n"), total(part(1)).alias("x"), total(part(2)).alias("y"))


FEATURES = f"SELECT puzzle, CAST(count(*) AS BIGINT) AS n_ex, count(DISTINCT op) AS n_ops, bool_or(out < 0) AS signed, bool_or(length(CAST(out AS VARCHAR)) >= 3) AS arith FROM ({EQUATIONS}) GROUP BY puzzle"


@query("P6_features", FEATURES)
def features(spark, sf_dir):
    """signed, operators and size features from the prompt's examples, without leaving the row."""
    e, _ = parse.parse_prompt(F.col("prompt"))
    ops = F.array_distinct(F.transform("e", lambda s: F.regexp_extract(s["input"], r"^[0-9]+([^0-9])", 1)))
    p = prompts(spark, sf_dir).select("puzzle", e.alias("e"))
    return p.select("puzzle", F.size("e").cast("long").alias("n_ex"), F.size(ops).cast("long").alias("n_ops"), F.exists("e", lambda s: F.startswith(s["output"], F.lit("-"))).alias("signed"), F.exists("e", lambda s: F.length(s["output"]) >= 3).alias("arith"))


_LINE = "regexp_extract(line, '^\\s*(\\d+)(\\D)(\\d+)\\s*=\\s*(\\S+)\\s*$', ['a', 'op', 'b', 'out'])"


@query("P8_prompt_feats", f"""SELECT puzzle, bool_or(regexp_matches(e.out, '\\D')) AS signed, count(DISTINCT e.op) AS n_ops, count(*) AS n_ex, count(DISTINCT CASE WHEN e.op IN ('+', '-', '*') THEN e.op END) AS arith_syms, bool_or(e.out = e.a || e.b OR e.out = e.b || e.a) AS has_concat,
    CAST(max(length(regexp_replace(e.out, '\\D', '', 'g'))) AS BIGINT) AS n_digits, CASE WHEN bool_or(regexp_matches(e.out, '\\D$')) THEN 'leftward' ELSE 'rightward' END AS reading FROM (SELECT puzzle, {_LINE} AS e FROM ({EXAMPLES})) GROUP BY puzzle""")
def prompt_feats(spark, sf_dir):
    """Seven features from the prompt alone, inside the row."""
    e, _ = parse.parse_prompt(F.col("prompt"))
    pattern = r"^\s*(\d+)(\D)(\d+)\s*$"
    part = lambda s, i: F.regexp_extract(s["input"], pattern, i)
    rows = prompts(spark, sf_dir).select("puzzle", F.transform(e, lambda s: F.struct(part(s, 1).alias("a"), part(s, 2).alias("op"), part(s, 3).alias("b"), s["output"].alias("out"))).alias("e"))
    ops = F.array_distinct(F.transform("e", lambda s: s["op"]))
    long = lambda c: c.cast("long")
    return rows.select(
        "puzzle", F.exists("e", lambda s: s["out"].rlike(r"\D")).alias("signed"), long(F.size(ops)).alias("n_ops"), long(F.size("e")).alias("n_ex"), long(F.size(F.array_intersect(ops, F.array(*map(F.lit, "+-*"))))).alias("arith_syms"),
        F.exists("e", lambda s: (s["out"] == F.concat(s["a"], s["b"])) | (s["out"] == F.concat(s["b"], s["a"]))).alias("has_concat"), long(F.array_max(F.transform("e", lambda s: F.length(F.regexp_replace(s["out"], r"\D", ""))))).alias("n_digits"),
        F.when(F.exists("e", lambda s: s["out"].rlike(r"\D$")), "leftward").otherwise("rightward").alias("reading"),
    )


@query("P9_example_count", "SELECT o_orderkey AS id, CAST(o_orderkey % 7 AS INT) AS examples FROM orders")
def example_count(spark, sf_dir):
    k = (F.col("o_orderkey") % 7).cast("int")
    prompt = F.when(k == 0, "no example").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.concat(F.lit("EX"), i)), " "))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), parse.example_count(prompt).alias("examples"))


@query("P10_symbol_pool", "SELECT p_partkey AS id, array_to_string(list_sort(list_distinct(string_split(regexp_replace(p_name, '\\s+', '', 'g'), ''))), '') AS pool FROM part")
def symbol_pool(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), parse.symbol_pool(F.col("p_name")).alias("pool"))


PAIRS = "SELECT id, p, list_distinct(list_transform(range(1, length(p)), lambda i: substr(p, i, 2))) AS pairs FROM (SELECT p_partkey AS id, replace(p_name, ' ', '') AS p FROM part)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged two-character tokens of each name, in order of first appearance; what a tokenizer may fuse."""
    p = F.replace("p_name", F.lit(" "), F.lit(""))
    two = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.substring(p, i, F.lit(2))))
    return table(spark, sf_dir, "part").filter(F.length(p) > 1).select(F.col("p_partkey").alias("id"), two.alias("pairs"))


@query("P11_merged_tokens", f"SELECT id, CAST(len(list_filter(pairs, lambda x: x IN ('ar', 'er', 'ti', 'P1', 't1', 'rt'))) AS BIGINT) AS fused FROM ({PAIRS}) WHERE length(p) > 1")
def merged_tokens(spark, sf_dir):
    known = F.array(*map(F.lit, ["ar", "er", "ti", "P1", "t1", "rt"]))
    return pairs(spark, sf_dir).select("id", F.size(F.array_intersect("pairs", known)).cast("long").alias("fused"))


@query("P12_fused_tokens", "SELECT id, array_to_string(list_filter(list_transform(range(1, length(p)), lambda i: CASE WHEN instr(p, substr(p, i, 2)) = i THEN substr(p, i, 2) END), lambda x: x IS NOT NULL), ' ') AS fused FROM (SELECT p_partkey AS id, replace(p_name, ' ', '') AS p FROM part) WHERE length(p) > 1")
def fused_tokens(spark, sf_dir):
    return pairs(spark, sf_dir).select("id", F.array_join("pairs", " ").alias("fused"))


SIGNED = f"SELECT puzzle, ex, op, CASE WHEN out >= 0 THEN CAST(out AS VARCHAR) WHEN puzzle % 3 = 0 THEN CAST(out AS VARCHAR) WHEN puzzle % 3 = 1 THEN op || abs(out) ELSE abs(out) || op END AS s FROM ({EQUATIONS})"


def signed_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, m = equations(spark, sf_dir), F.col("puzzle") % 3
    size = F.abs("out").cast("string")
    return e.select("puzzle", "ex", "op", F.when((F.col("out") >= 0) | (m == 0), F.col("out").cast("string")).when(m == 1, F.concat("op", size)).otherwise(F.concat(size, F.col("op"))).alias("s"))


@query("P13_sign_format", f"""SELECT puzzle, coalesce(arg_min(kind, ex) FILTER (kind IS NOT NULL), 'none') AS kind, coalesce(arg_min(CASE kind WHEN 'minus' THEN '-' WHEN 'prefix' THEN s[1] ELSE s[-1] END, ex) FILTER (kind IS NOT NULL), '') AS glyph
    FROM (SELECT *, CASE WHEN s[1] = '-' THEN 'minus' WHEN NOT regexp_matches(s, '^[0-9]') THEN 'prefix' WHEN NOT regexp_matches(s, '[0-9]$') THEN 'suffix' END AS kind FROM ({SIGNED})) GROUP BY puzzle""")
def sign_format(spark, sf_dir):
    g = signed_outputs(spark, sf_dir).groupBy("puzzle").agg(F.array_sort(F.collect_list(F.struct("ex", "s"))).alias("o"))
    return g.select("puzzle", parse.sign_format(F.transform("o", lambda x: x["s"])).alias("f")).select("puzzle", "f.kind", "f.glyph")


NORM = "CASE WHEN s[1] = '-' THEN s WHEN NOT regexp_matches(s, '^[0-9]') THEN '-' || substr(s, 2) WHEN NOT regexp_matches(s, '[0-9]$') THEN '-' || substr(s, 1, length(s) - 1) ELSE s END"


@query("P14_output_norm", f"SELECT puzzle, ex, {NORM} AS norm, CASE WHEN NOT regexp_matches(s, '^[0-9]') THEN '-' || substr(s, 2) WHEN NOT regexp_matches(s, '[0-9]$') THEN substr(s, 1, length(s) - 1) || '-' ELSE s END AS in_place, CASE WHEN ({NORM})[1] = '-' THEN '-' || reverse(substr({NORM}, 2)) ELSE reverse({NORM}) END AS leftward FROM ({SIGNED})")
def output_norm(spark, sf_dir):
    s = F.col("s")
    return signed_outputs(spark, sf_dir).select("puzzle", "ex", parse.output_norm(s).alias("norm"), parse.sign_in_place(s).alias("in_place"), parse.target_of(s, F.lit(True)).alias("leftward"))


@query("P15_render_answer", f"SELECT puzzle, ex, CASE WHEN out >= 0 OR puzzle % 3 = 0 THEN CAST(out AS VARCHAR) WHEN puzzle % 3 = 1 THEN abs(out) || op ELSE op || abs(out) END AS rendered FROM ({EQUATIONS})")
def render_answer(spark, sf_dir):
    m = F.col("puzzle") % 3
    kind = F.when(m == 0, "minus").when(m == 1, "suffix").otherwise("prefix")
    return equations(spark, sf_dir).select("puzzle", "ex", parse.render_answer(F.col("out").cast("string"), kind, F.col("op")).alias("rendered"))


@query("P16_squash", r"SELECT doc_id AS id, md5(regexp_replace(text, '\s+', '', 'g')) AS squashed FROM documents")
def squash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(parse.squash(F.col("text")).cast("binary")).alias("squashed"))


@query("P17_runs_text", """WITH v AS (SELECT DISTINCT o_custkey AS id, o_orderkey % 30 AS v FROM orders), g AS (SELECT *, v - row_number() OVER (PARTITION BY id ORDER BY v) AS g FROM v),
    r AS (SELECT id, min(v) AS low, CASE WHEN count(*) >= 3 THEN min(v) || '-' || max(v) ELSE string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) END AS t FROM g GROUP BY id, g)
    SELECT id, string_agg(t, ',' ORDER BY low) AS runs FROM r GROUP BY id""")
def runs_text(spark, sf_dir):
    """Gaps and islands inside the row."""
    v = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_set(F.col("o_orderkey") % 30)).alias("v"))
    return v.select("id", parse.runs_text(F.col("v")).alias("runs"))


@query("P18_hypothesis_features", "SELECT id, n_rotate, n_shift, n_not FROM (SELECT o_orderkey AS id, CAST(o_orderkey % 2 AS BIGINT) + CAST(o_orderkey % 5 = 0 AS BIGINT) AS n_rotate, CAST((o_orderkey + 1) % 2 AS BIGINT) AS n_shift, CAST(o_orderkey % 3 = 0 AS BIGINT) AS n_not FROM orders)")
def hypothesis_features(spark, sf_dir):
    """Counts of transforms among a hypothesis's arguments."""
    k = F.col("o_orderkey")
    args = F.array(F.when(k % 2 == 1, "rotl3").otherwise("shl2f0"), F.when(k % 5 == 0, "rotr1").otherwise("id"), F.when(k % 3 == 0, "not_id").otherwise("id"))
    count = lambda p: F.size(F.filter("args", lambda a: a.rlike(p))).cast("long")
    return table(spark, sf_dir, "orders").select(k.alias("id"), args.alias("args")).select("id", count("rot").alias("n_rotate"), count("sh[lr]").alias("n_shift"), count("^not_").alias("n_not"))


@query("P19_positional_value", "SELECT o_orderkey AS id, CAST(o_custkey AS BIGINT) AS standard, CAST(reverse(CAST(o_custkey AS VARCHAR)) AS BIGINT) AS little FROM orders")
def positional_value(spark, sf_dir):
    """Digits disguised as letters, read back under a map in either order."""
    digits = F.create_map(*[x for i in range(10) for x in (F.lit("ABCDEFGHIJ"[i]), F.lit(i))])
    symbols = F.split(F.translate(F.col("o_custkey").cast("string"), "0123456789", "ABCDEFGHIJ"), "")
    value = lambda little: parse.positional_value(symbols, digits, F.lit(little))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), value(False).alias("standard"), value(True).alias("little"))


@query("P20_leading_symbols", f"SELECT puzzle, string_agg(DISTINCT s, '' ORDER BY s) AS leading FROM (SELECT puzzle, substr(CAST(a AS VARCHAR), 1, 1) AS s FROM ({EQUATIONS}) UNION ALL SELECT puzzle, substr(CAST(b AS VARCHAR), 1, 1) FROM ({EQUATIONS})) GROUP BY puzzle")
def leading_symbols(spark, sf_dir):
    g = equations(spark, sf_dir).groupBy("puzzle").agg(F.collect_list(F.array(F.col("a").cast("string"), F.col("b").cast("string"))).alias("t"))
    return g.select("puzzle", F.array_join(F.array_sort(parse.leading_symbols(F.flatten("t"))), "").alias("leading"))


@query("S12_heading_scan", "SELECT line_no, heading, text FROM (SELECT conv_id * 100 + turn AS line_no, last_value(CASE WHEN turn = 0 THEN left(text, 10) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS heading, left(text, 5) AS text FROM conversations)")
def heading_scan(spark, sf_dir):
    """Rows under the last heading before them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations")
    heading = F.last(F.when(F.col("turn") == 0, F.left("text", F.lit(10))), ignorenulls=True).over(w)
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("line_no"), heading.alias("heading"), F.left("text", F.lit(5)).alias("text"))
