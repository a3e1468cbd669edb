"""Extraction, scoring and accuracy of model outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import num, text
from tracewright.plans.inputs import OUTPUTS, PREDICTED, outputs, table
from tracewright.plans.registry import query

TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
#: verify() in SQL, for answers and predictions without underscores, type suffixes or NaN.
VERIFY = """CASE WHEN regexp_full_match({g}, '[01]+') THEN lower({g}) = lower({p})
    WHEN regexp_full_match({g}, '[+-]?\\d+(\\.\\d+)?') AND regexp_full_match({p}, '[+-]?\\d+(\\.\\d+)?') THEN
        abs(CAST({g} AS DOUBLE) - CAST({p} AS DOUBLE)) <= greatest(0.01 * greatest(abs(CAST({g} AS DOUBLE)), abs(CAST({p} AS DOUBLE))), 1e-5)
    ELSE lower({g}) = lower({p}) END"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = outputs(spark, sf_dir).withColumn("predicted", text.final_answer(F.col("output")))
    return df.withColumn("correct", num.verify(F.col("answer"), F.col("predicted")))


SCORED = f"SELECT *, {VERIFY.format(g='answer', p='predicted')} AS correct FROM ({PREDICTED})"


@query("E1_eval_accuracy", f"SELECT category, count(*) AS n, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS k, round(avg(CAST(correct AS INT)), 6) AS accuracy FROM ({SCORED}) GROUP BY category")
def eval_accuracy(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("int")).alias("k"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))


@query("X1_boxed_live", f"SELECT id, coalesce(list_filter(boxes, lambda x: x <> '')[-1], boxes[-1]) AS box FROM ({PREDICTED})")
def boxed_live(spark, sf_dir):
    return outputs(spark, sf_dir).select("id", text.boxed_live(F.col("output")).alias("box"))


@query("X2_boxed_legacy", rf"SELECT id, coalesce(list_filter(b, lambda x: x <> '')[-1], b[-1]) AS box FROM (SELECT id, list_transform(regexp_extract_all(output, '\\boxed\{{([^}}]*)(?:\}}|\z)', 1), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS b FROM ({OUTPUTS}))")
def boxed_legacy(spark, sf_dir):
    return outputs(spark, sf_dir).select("id", text.boxed_legacy(F.col("output")).alias("box"))


@query("X3_answer_phrase", rf"""SELECT id, coalesce(trim(regexp_extract_all(output, '(?i)The final answer is:\s*([^\n]+)', 1)[-1]), trim(regexp_extract_all(output, '(?i)Final answer is:\s*([^\n]+)', 1)[-1]),
    trim(regexp_extract_all(output, '(?i)Final answer\s*[:：]\s*([^\n]+)', 1)[-1])) AS phrase FROM ({OUTPUTS})""")
def answer_phrase(spark, sf_dir):
    return outputs(spark, sf_dir).select("id", text.answer_phrase(F.col("output")).alias("phrase"))


@query("X4_last_number", rf"SELECT id, regexp_extract_all(output, '-?\d+(?:\.\d+)?')[-1] AS number FROM ({OUTPUTS})")
def last_number(spark, sf_dir):
    return outputs(spark, sf_dir).select("id", text.last_number(F.col("output")).alias("number"))


@query("X5_last_line", rf"SELECT id, coalesce(list_filter(list_transform(string_split(output, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[-1], 'NOT_FOUND') AS line FROM ({OUTPUTS})")
def last_line(spark, sf_dir):
    return outputs(spark, sf_dir).select("id", F.coalesce(text.last_line(F.col("output")), F.lit(text.NOT_FOUND)).alias("line"))


@query("X6_final_answer", f"SELECT id, predicted FROM ({PREDICTED})")
def final_answer(spark, sf_dir):
    return outputs(spark, sf_dir).select("id", text.final_answer(F.col("output")).alias("predicted"))


@query("X7_first_box", rf"SELECT id, nullif(regexp_extract(output, '\\?boxed\{{(.*?)\}}', 1, 's'), '') AS box FROM ({OUTPUTS})")
def first_box(spark, sf_dir):
    return outputs(spark, sf_dir).select("id", text.first_box(F.col("output")).alias("box"))


@query("X8_strip_boxes", rf"SELECT id, md5(regexp_replace(regexp_replace(output, '\\boxed\{{[^}}]*\}}', '', 'g'), '\s+$', '')) AS rest FROM ({OUTPUTS})")
def strip_boxes(spark, sf_dir):
    return outputs(spark, sf_dir).select("id", F.md5(text.strip_boxes(F.col("output")).cast("binary")).alias("rest"))


@query("X9_split_thinking", rf"""SELECT id, CASE WHEN contains(output, '</think>') THEN regexp_replace(regexp_replace(split_part(output, '</think>', 1), '^\s*<think>', ''), '^\s+|\s+$', '', 'g') ELSE '' END AS thinking,
    md5(regexp_replace(CASE WHEN contains(output, '</think>') THEN substr(output, instr(output, '</think>') + 8) ELSE output END, '^\s+|\s+$', '', 'g')) AS answer FROM ({OUTPUTS})""")
def split_thinking(spark, sf_dir):
    thinking, answer = text.split_thinking(F.col("output"))
    return outputs(spark, sf_dir).select("id", thinking.alias("thinking"), F.md5(answer.cast("binary")).alias("answer"))


NAMES = "SELECT c_custkey AS id, c_name AS a, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN replace(c_name, '1', '7') ELSE c_name || '#' END AS b FROM customer"


@query("X10_first_difference", f"SELECT id, CASE WHEN a = b THEN -1 ELSE coalesce(list_position(list_transform(range(1, greatest(length(a), length(b)) + 1), lambda i: substr(a, i, 1) = substr(b, i, 1)), false), 0) - 1 END AS at FROM ({NAMES})")
def first_difference(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 3
    b = F.when(k == 0, F.col("c_name")).when(k == 1, F.replace("c_name", F.lit("1"), F.lit("7"))).otherwise(F.concat("c_name", F.lit("#")))
    return c.select(F.col("c_custkey").alias("id"), text.first_difference(F.col("c_name"), b).alias("at"))


@query("X11_token_divergence", r"""WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations WHERE role = 'assistant'),
    p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2),
    d AS (SELECT *, list_position(list_transform(range(1, greatest(len(x), len(y)) + 1), lambda i: x[i] IS NOT DISTINCT FROM y[i]), false) - 1 AS pos FROM p)
    SELECT conv_id, turn, CAST(pos AS INT) AS "at", array_to_string(x[greatest(1, pos - 4) : pos + 6], ' ') AS context FROM d WHERE pos >= 0""")
def token_divergence(spark, sf_dir):
    """The first differing token of two outputs of a conversation, with five tokens on either side."""
    t = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.split("text", " ").alias("w"))
    other = t.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("w").alias("y"))
    same = F.zip_with("w", "y", lambda x, y: x.eqNullSafe(y))
    p = t.join(other, ["conv_id", "turn"]).withColumn("at", F.array_position(same, False).cast("int") - 1).filter("at >= 0")
    begin = F.greatest(F.lit(1), F.col("at") - 4)
    return p.select("conv_id", "turn", "at", F.array_join(F.slice("w", begin, F.col("at") + 7 - begin), " ").alias("context"))


@query("X12_snippet", "SELECT id, CASE WHEN pos > 0 THEN replace(substr(text, greatest(1, pos - 20), pos - greatest(1, pos - 20) + 24), chr(10), ' ') END AS snippet FROM (SELECT doc_id AS id, text, instr(text, 'tion') AS pos FROM documents)")
def snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.snippet(F.col("text"), "tion", 20).alias("snippet"))


READ = "SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'reading order = [rightward, leftward]; Confirm reading order = leftward' WHEN 1 THEN 'Confirm reading order = rightward' WHEN 2 THEN 'Confirm reading order = rightward, Confirm reading order = leftward' ELSE text END AS cot FROM documents"


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    cot = F.when(k == 0, "reading order = [rightward, leftward]; Confirm reading order = leftward").when(k == 1, "Confirm reading order = rightward").when(k == 2, "Confirm reading order = rightward, Confirm reading order = leftward").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), cot.alias("cot"))


@query("X13_reading_order", f"SELECT id, coalesce(regexp_extract_all(cot, 'Confirm reading order = ([a-z]+)', 1)[-1], 'none') AS reading, CASE WHEN contains(cot, 'leftward') THEN 'leftward' ELSE 'rightward' END AS contained FROM ({READ})")
def reading_order(spark, sf_dir):
    """The last confirmed reading order, and the one by containment."""
    found = text.last(F.regexp_extract_all("cot", F.lit("Confirm reading order = ([a-z]+)"), F.lit(1)))
    return traces(spark, sf_dir).select("id", F.coalesce(found, F.lit("none")).alias("reading"), F.when(F.contains("cot", F.lit("leftward")), "leftward").otherwise("rightward").alias("contained"))


FAMILIES = [("\u2225", "concat"), ("\u00d7", "mul"), (r"\+", "add"), (r"-|\|", "sub")]
LOCKS = "SELECT o_orderkey AS id, 'lock f = a' || substr(chr(215) || '+-' || chr(8741), CAST(o_orderkey % 4 AS INT) + 1, 1) || 'b, lock g = |a-b|, lock h = a+b' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '+1' END AS cot FROM orders"


@query("X15_locked_families", f"""SELECT id, list_distinct(list_transform(regexp_extract_all(cot, 'lock \\w+ = ([^,]+)', 1), lambda x: CASE WHEN contains(x, chr(8741)) THEN 'concat' WHEN contains(x, chr(215)) THEN 'mul' WHEN contains(x, '+') THEN 'add' ELSE 'sub' END)).list_sort().array_to_string(',') AS families FROM ({LOCKS})""")
def locked_families(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    sign = F.substring(F.lit("\u00d7+-\u2225"), (F.col("o_orderkey") % 4).cast("int") + 1, F.lit(1))
    cot = F.concat(F.lit("lock f = a"), sign, F.lit("b, lock g = |a-b|, lock h = a+b"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("+1"))
    locks = F.regexp_extract_all(cot, F.lit(r"lock \w+ = ([^,]+)"), F.lit(1))
    named = F.array_sort(F.array_distinct(F.transform(locks, lambda x: text.first_match(x, FAMILIES, "none"))))
    return o.select(F.col("o_orderkey").alias("id"), F.array_join(named, ",").alias("families"))


@query("X16_path_bucket", "SELECT id, CASE WHEN regexp_matches(cot, 'Confirm.*Confirm') THEN 'twice' WHEN contains(cot, '[rightward') THEN 'tree' WHEN contains(cot, 'Confirm') THEN 'direct' ELSE 'none' END AS bucket, count(*) AS n FROM (" + READ + ") GROUP BY ALL")
def path_bucket(spark, sf_dir):
    bucket = text.first_match(F.col("cot"), [("Confirm.*Confirm", "twice"), (r"\[rightward", "tree"), ("Confirm", "direct")], "none")
    df = traces(spark, sf_dir).select("id", bucket.alias("bucket"))
    return df.groupBy("id", "bucket").agg(F.count("*").alias("n"))


@query("X17_scenario", f"SELECT scenario, count(*) AS n FROM (SELECT CASE WHEN contains(tail, 'leftward') THEN 'deduce' WHEN contains(tail, 'rightward') THEN 'query-only' ELSE 'unsolvable' END AS scenario FROM (SELECT substr(cot, greatest(1, length(cot) - 399)) AS tail FROM ({READ}))) GROUP BY scenario")
def scenario(spark, sf_dir):
    tail = F.substring("cot", F.greatest(F.lit(1), F.length("cot") - 399), F.lit(400))
    return traces(spark, sf_dir).select(text.first_match(tail, [("leftward", "deduce"), ("rightward", "query-only")], "unsolvable").alias("scenario")).groupBy("scenario").agg(F.count("*").alias("n"))


@query("X18_selected_rules", r"SELECT puzzle, bit, regexp_extract('bit' || bit || ' = in' || ((bit + puzzle) % 8), '= (in\d)', 1) AS rule FROM (SELECT o_orderkey AS puzzle, unnest(range(8)) AS bit FROM orders)")
def selected_rules(spark, sf_dir):
    """An eight-line block of per-bit rules, parsed back."""
    block = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(F.lit("bit"), i, F.lit(" = in"), (i + F.col("o_orderkey")) % 8)), "\n")
    lines = F.posexplode(F.split(F.regexp_extract(block, r"(?s)(bit0 = .*bit7 = in\d)", 1), "\n"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("puzzle"), lines.alias("bit", "line")).select("puzzle", F.col("bit").cast("long").alias("bit"), F.regexp_extract("line", r"= (in\d)", 1).alias("rule"))


@query("X19_insert_before", r"SELECT id, md5(CASE WHEN instr(output, '\boxed{') > 0 THEN substr(output, 1, instr(output, '\boxed{') - 1) || '[check]' || substr(output, instr(output, '\boxed{')) ELSE output END) AS text FROM (" + OUTPUTS + ")")
def insert_before(spark, sf_dir):
    return outputs(spark, sf_dir).select("id", F.md5(text.insert_before(F.col("output"), "\\boxed{", F.lit("[check]")).cast("binary")).alias("text"))


@query("X20_keyword_mask", "SELECT p_partkey AS id FROM part WHERE regexp_matches(lower(p_type), 'steel|brass')")
def keyword_mask(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.lower("p_type").rlike("steel|brass")).select(F.col("p_partkey").alias("id"))


KINDS = [("cipher|ch", "cipher"), ("the", "english"), ("der|und", "german"), ("[0-9]", "number")]


@query("X21_prompt_type", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(t, 'cipher|ch') THEN 'cipher' WHEN regexp_matches(t, 'the') THEN 'english' WHEN regexp_matches(t, 'der|und') THEN 'german' WHEN regexp_matches(t, '[0-9]') THEN 'number' ELSE 'other' END AS kind FROM (SELECT lower(text) AS t FROM documents)) GROUP BY kind")
def prompt_type(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(text.first_match(F.lower("text"), KINDS, "other").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


FORBIDDEN = ["the", "that", "und", "con", "avec"]


@query("X22_forbidden_phrases", "SELECT phrase, CAST(sum(CAST(contains(lower(text), phrase) AS INT)) AS BIGINT) AS n FROM documents, (SELECT unnest(['the', 'that', 'und', 'con', 'avec']) AS phrase) GROUP BY phrase")
def forbidden_phrases(spark, sf_dir):
    """One pass: a sum for each phrase, then one row each; no product of rows and phrases."""
    d = table(spark, sf_dir, "documents").select(F.lower("text").alias("t"))
    sums = d.agg(*(F.sum(F.contains("t", F.lit(p)).cast("int")).alias(p) for p in FORBIDDEN))
    return sums.unpivot([], FORBIDDEN, "phrase", "n")


@query("X23_interval_witness", r"SELECT id, CAST(len(regexp_extract_all(s, '\[\d+,\d+\]')) AS BIGINT) AS n FROM (SELECT o_orderkey AS id, repeat('x in [' || (o_orderkey % 9) || ',' || (o_orderkey % 13 + 9) || '] ', CAST(o_orderkey % 4 AS INT)) AS s FROM orders)")
def interval_witness(spark, sf_dir):
    one = F.concat(F.lit("x in ["), F.col("o_orderkey") % 9, F.lit(","), F.col("o_orderkey") % 13 + 9, F.lit("] "))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.regexp_count(F.repeat(one, (F.col("o_orderkey") % 4).cast("int")), F.lit(r"\[\d+,\d+\]")).cast("long").alias("n"))


@query("X24_trace_metrics", "SELECT doc_id AS id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, CAST(length(text) AS BIGINT) AS chars, CAST(len(regexp_extract_all(text, '[,.]')) AS BIGINT) AS marks FROM documents WHERE text IS NOT NULL")
def trace_metrics(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.select(F.col("doc_id").alias("id"), F.size(F.split("text", "\n", -1)).cast("long").alias("lines"), F.length("text").cast("long").alias("chars"), F.regexp_count("text", F.lit("[,.]")).cast("long").alias("marks"))


@query("X25_hash_id", "SELECT doc_id AS id, 'aug' || substr(sha1(text), 1, 8) AS hash_id FROM documents")
def hash_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.hash_id(F.col("text")).alias("hash_id"))


@query("X26_id_stem", "SELECT stem, count(*) AS n FROM (SELECT regexp_replace('q' || (o_custkey % 100) || CASE o_orderkey % 3 WHEN 0 THEN '-d2' WHEN 1 THEN '-p0' ELSE '' END, '-(d|p)\\d+$', '') AS stem FROM orders) GROUP BY stem")
def id_stem(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    ids = F.concat(F.lit("q"), F.col("o_custkey") % 100, F.when(k == 0, "-d2").when(k == 1, "-p0").otherwise(""))
    return table(spark, sf_dir, "orders").select(text.id_stem(ids).alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))


@query("X27_ascii_safe", r"SELECT doc_id AS id, md5(regexp_replace(text, '[^\x00-\x7F]', '?', 'g')) AS safe FROM documents")
def ascii_safe(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(text.ascii_safe(F.col("text")).cast("binary")).alias("safe"))


@query("V1_verify", f"SELECT id, predicted, correct FROM ({SCORED})")
def verify(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "predicted", "correct")


@query("V2_answers_match", """SELECT id, coalesce(p = g OR lower(p) = lower(g) OR CASE WHEN y = 0 THEN abs(x) < 1e-6 ELSE abs(x - y) / abs(y) <= 0.01 END, false) AS match FROM (
    SELECT o_orderkey AS id, CAST(o_orderkey % 300 AS VARCHAR) AS g, CAST(o_orderkey % 300 + o_orderkey % 3 AS VARCHAR) AS p, CAST(o_orderkey % 300 AS DOUBLE) AS y, CAST(o_orderkey % 300 + o_orderkey % 3 AS DOUBLE) AS x FROM orders)""")
def answers_match(spark, sf_dir):
    g, p = (F.col("o_orderkey") % 300).cast("string"), (F.col("o_orderkey") % 300 + F.col("o_orderkey") % 3).cast("string")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), num.answers_match(p, g).alias("match"))


@query("A2_overall_accuracy", f"SELECT count(*) AS n, round(avg(CAST(correct AS INT)), 6) AS accuracy FROM ({SCORED})")
def overall_accuracy(spark, sf_dir):
    return scored(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))


@query("A3_category_accuracy", f"SELECT category, lang, count(*) AS n, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS k, round(avg(CAST(correct AS INT)), 6) AS accuracy FROM ({SCORED}) GROUP BY GROUPING SETS ((category), (lang))")
def category_accuracy(spark, sf_dir):
    """Two taxonomies in one pass."""
    df = scored(spark, sf_dir).select("category", "lang", F.col("correct").cast("int").alias("c"))
    return df.groupingSets([["category"], ["lang"]], "category", "lang").agg(F.count("*").alias("n"), F.sum("c").alias("k"), F.round(F.avg("c"), 6).alias("accuracy")).select("category", "lang", "n", "k", "accuracy")


@query("O11_sample_per_group", f"SELECT category, correct, id FROM (SELECT *, row_number() OVER (PARTITION BY category, correct ORDER BY id) AS k FROM ({SCORED})) WHERE k <= 2")
def sample_per_group(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("category", "correct").orderBy("id")
    return scored(spark, sf_dir).select("category", "correct", "id").withColumn("k", F.row_number().over(w)).filter("k <= 2").drop("k")
