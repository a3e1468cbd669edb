"""Training-set materialisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import tokens
from tracewright.functions.text import boxed_live
from tracewright.operators import bitrules
from tracewright.operators import trainset as ops
from tracewright.operators.ranges import numbered
from tracewright.plans.inputs import CORPUS, OUTPUTS, PREDICTED, corpus, outputs, table
from tracewright.plans.registry import query
from tracewright.plans.solving import by_puzzles, words


@query("T1_chat_prompt", "SELECT conv_id, turn, '<|im_start|>' || role || chr(10) || text || chr(10) || 'Put the answer in \\boxed{}.<|im_end|>' || chr(10) AS prompt FROM conversations WHERE role = 'user'")
def chat_prompt(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("\nPut the answer in \\boxed{}.<|im_end|>\n")).alias("prompt"))


@query("T2_completion", f"SELECT id, md5(output || '</think>' || '\\boxed{{' || coalesce(CASE WHEN contains(output, '\\boxed{{') THEN predicted END, answer) || '}}<|im_end|>') AS completion FROM ({PREDICTED})")
def completion(spark, sf_dir):
    o = F.col("output")
    text = F.concat(o, F.lit("</think>\\boxed{"), F.coalesce(boxed_live(o), "answer"), F.lit("}<|im_end|>"))
    return outputs(spark, sf_dir).select("id", F.md5(text.cast("binary")).alias("completion"))


#: Token ids of a text: lengths of its words, a stand-in that both engines have.
IDS = "SELECT doc_id AS id, lang, list_transform(string_split('Write in ' || coalesce(lang, 'any language') || ' for ' || source, ' '), lambda x: CAST(length(x) AS INT)) AS prompt, list_transform(string_split(text, ' '), lambda x: CAST(length(x) AS INT)) AS completion FROM documents WHERE text IS NOT NULL"


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda c: F.transform(F.split(c, " ", -1), lambda x: F.length(x))
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), "lang", ids(F.concat(F.lit("Write in "), F.coalesce("lang", F.lit("any language")), F.lit(" for "), "source")).alias("prompt"), ids(F.col("text")).alias("completion"))


@query("T3_tokenise")
def tokenise(spark, sf_dir):
    """Ids of prompt and whole text by a public tokenizer, put together, ended and cut at 512."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), tokens.token_ids(F.concat(F.lit("Write for "), "source")).alias("prompt"), tokens.token_ids(F.col("text")).alias("completion"))
    ids = F.slice(F.concat("prompt", "completion", F.array(F.lit(tokens.END_ID))), 1, 512)
    return d.select("id", F.size("prompt").alias("n_prompt"), F.size("completion").alias("n_completion"), ids.alias("ids"))


@query("T4_mask_and_shift", f"SELECT id, len(ids) - 1 AS n, CAST(coalesce(list_sum(ids[2:]), 0) AS BIGINT) AS targets, greatest(0, len(ids) - greatest(1, p)) AS weights FROM (SELECT id, (prompt || completion)[:256] AS ids, least(len(prompt), 256) AS p FROM ({IDS}))")
def mask_and_shift(spark, sf_dir):
    """T4 and T5."""
    m = ops.mask_and_shift(F.col("prompt"), F.col("completion"), 256)
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return token_ids(spark, sf_dir).select("id", m.alias("m")).select("id", F.size("m.tokens").cast("long").alias("n"), add(F.col("m.targets")).alias("targets"), add(F.col("m.weights")).alias("weights"))


@query("T6_prefix_lookup", f"SELECT prefix, max(id) AS id, count(*) AS n FROM (SELECT id, array_to_string(completion[:3], ',') AS prefix FROM ({IDS})) GROUP BY 1")
def prefix_lookup(spark, sf_dir):
    """The last id of each prefix, collisions counted."""
    return token_ids(spark, sf_dir).groupBy(F.array_join(F.slice("completion", 1, 3), ",").alias("prefix")).agg(F.max("id").alias("id"), F.count("*").alias("n"))


INTERLEAVED = f"SELECT id, category, (row_number() OVER (PARTITION BY category ORDER BY md5('1|' || id), id) - 1) / count(*) OVER (PARTITION BY category) AS position FROM ({CORPUS})"


@query("T7_interleave", f"SELECT id, category, round(position, 9) AS position FROM ({INTERLEAVED})")
def interleave(spark, sf_dir):
    from tracewright.operators.corpus import hash_order, hash_piece

    c = corpus(spark, sf_dir).select("id", "category", hash_order(1, "id").alias("h"))
    return ops.interleave(c, "category", ["h", "id"], hash_piece("h")).select("id", "category", F.round("position", 9).alias("position"))


@query("T8_batches", f"SELECT batch, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 32 AS batch FROM ({CORPUS})) GROUP BY 1")
def batches(spark, sf_dir):
    n = numbered(corpus(spark, sf_dir).select("id"), "id")
    return n.groupBy(F.floor(F.col("row_no") / 32).alias("batch")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("T9_rank_split", f"SELECT batch, rank, count(*) AS n FROM (SELECT r // 32 AS batch, r % 32 // 16 AS rank FROM (SELECT row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n FROM ({CORPUS})) WHERE r < n // 32 * 32) GROUP BY 1, 2")
def rank_split(spark, sf_dir):
    """Full batches only, each cut into two contiguous shares."""
    n = numbered(corpus(spark, sf_dir).select("id"), "id", total="rows").filter("row_no < rows - rows % 32")
    return n.groupBy(F.floor(F.col("row_no") / 32).alias("batch"), F.floor(F.col("row_no") % 32 / 16).alias("rank")).agg(F.count("*").alias("n"))


@query("T10_micro_batches", f"""SELECT id, micro, CAST(width AS INT) AS width, md5(array_to_string(list_resize(completion, width, 0), ',')) AS padded, CAST(len(completion) AS BIGINT) AS attended
    FROM (SELECT *, max(len(completion)) OVER (PARTITION BY micro) AS width FROM (SELECT id, completion, (row_number() OVER (ORDER BY id) - 1) // 4 AS micro FROM ({IDS})))""")
def micro_batches(spark, sf_dir):
    """Rows of four, filled up to the widest of each, with attention masks."""
    t = token_ids(spark, sf_dir)
    n = numbered(t.select("id"), "id")
    m = ops.micro_batches(t.join(n, "id"), "row_no", "completion", 4)
    attended = F.aggregate("padded.mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return m.select("id", "micro", "width", F.md5(F.array_join("padded.ids", ",").cast("binary")).alias("padded"), attended.alias("attended"))


@query("T11_weighted_loss", "SELECT l_orderkey AS id, round(coalesce(sum(l_quantity * l_linenumber) / nullif(sum(l_linenumber), 0), 0), 6) AS loss FROM lineitem GROUP BY 1")
def weighted_loss(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy(F.col("l_orderkey").alias("id")).agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("l_quantity") * F.col("l_linenumber")), F.sum("l_linenumber")), F.lit(0.0)), 6).alias("loss"))


LOSSES = "SELECT l_orderkey AS id, list(l_quantity / 10.0 ORDER BY l_linenumber, l_quantity) AS ce FROM lineitem GROUP BY 1"


@query("T12_loss_variants", f"""SELECT id, round(list_sum(list_transform(ce, lambda x: x * pow(1 - exp(-x), 2))) / len(ce), 6) AS focal, round(5 * ln(list_sum(list_transform(ce, lambda x: exp(x / 5)))), 6) AS soft, round(list_avg(list_reverse_sort(ce)[:3]), 6) AS top3,
    round(list_sum(list_transform(range(1, len(ce) + 1), lambda i: ce[i] * CASE WHEN i = len(ce) THEN 5 ELSE 1 END)) / (len(ce) + 4), 6) AS boxed FROM ({LOSSES})""")
def loss_variants(spark, sf_dir):
    """Focal, soft maximum, mean of the largest three, and five times the weight on the last token."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity") / 10.0).alias("c")))).alias("s"))
    c = g.select("id", F.transform("s", lambda x: x["c"]).alias("ce"))
    ones = F.transform("ce", lambda x: F.lit(1.0))
    top = F.slice(F.reverse(F.array_sort("ce")), 1, 3)
    last = F.transform("ce", lambda x, i: F.when(i == F.size("ce") - 1, 5.0).otherwise(1.0))
    focal = F.transform("ce", lambda x: x * F.pow(1 - F.exp(-x), F.lit(2)))
    return c.select("id", F.round(ops.mean_loss(focal, ones), 6).alias("focal"), F.round(ops.log_sum_exp(F.col("ce"), 5.0), 6).alias("soft"), F.round(ops.mean_loss(top, F.transform(top, lambda x: F.lit(1.0))), 6).alias("top3"), F.round(ops.mean_loss(F.col("ce"), last), 6).alias("boxed"))


@query("T13_schedules", """SELECT s AS step, round(1e-3 * (1 - s / 1000.0), 9) AS linear, round(CASE WHEN s < 50 THEN 1e-3 * (s + 1) / 50 ELSE 5e-4 * (1 + cos(pi() * (s - 50) / 950.0)) END, 9) AS cosine,
    round(CASE WHEN s < 50 THEN 1e-3 * (s + 1) / 50 WHEN s < 800 THEN 1e-3 ELSE 1e-3 * (1000 - s) / 200 END, 9) AS wsd FROM range(1000) r(s)""")
def schedules(spark, sf_dir):
    s = F.col("step")
    r = spark.range(1000).withColumnRenamed("id", "step")
    return r.select("step", F.round(ops.linear(s, 1000, 1e-3), 9).alias("linear"), F.round(ops.warm_cosine(s, 1000, 1e-3), 9).alias("cosine"), F.round(ops.warm_stable_decay(s, 1000, 1e-3), 9).alias("wsd"))


@query("T14_snapshots", "SELECT DISTINCT step FROM (SELECT unnest(range(60, 246, 60)) AS step UNION ALL SELECT CAST(round_even(245 * p, 0) AS BIGINT) FROM (SELECT unnest([0.8, 0.85, 0.9, 0.95, 1.0]) AS p))")
def snapshots(spark, sf_dir):
    marks = F.transform(F.array(*map(F.lit, (0.8, 0.85, 0.9, 0.95, 1.0))), lambda p: F.bround(p * 245).cast("bigint"))
    return spark.range(1).select(F.explode(F.array_sort(F.array_union(F.sequence(F.lit(60).cast("bigint"), F.lit(245).cast("bigint"), F.lit(60).cast("bigint")), marks))).alias("step"))


#: A rejected text emitted its end where it ends in a stop; the chosen one always did.
_SIDES = f"SELECT id, source_key, prompt, completion, right(text, 1) = '.' AS ended FROM ({IDS}) JOIN (SELECT doc_id, text, source AS source_key FROM documents) d ON id = d.doc_id"


@query("T15_preference_pairs", f"""WITH s AS ({_SIDES}), p AS (SELECT c.id, c.prompt, c.completion AS chosen, r.completion AS rejected, r.ended FROM s c JOIN s r ON c.id % 2 = 0 AND r.id = c.id + 1)
    SELECT id, CAST(least(1024, len(prompt) + len(chosen) + 1) AS INT) AS chosen_tokens, CAST(least(1024, len(prompt) + len(rejected) + CAST(ended AS INT)) AS INT) AS rejected_tokens,
        CAST(least(1024, len(prompt) + len(chosen) + 1) - len(prompt) AS BIGINT) AS chosen_loss, CAST(least(1024, len(prompt) + len(rejected) + CAST(ended AS INT)) - len(prompt) AS BIGINT) AS rejected_loss,
        CAST(list_sum((prompt || chosen || [-1])[:1024]) AS BIGINT) AS chosen_sum, CAST(list_sum((prompt || rejected || CASE WHEN ended THEN [-1] ELSE [] END)[:1024]) AS BIGINT) AS rejected_sum FROM p""")
def preference_pairs(spark, sf_dir):
    """Two texts after one prompt, the first preferred: ids, masks and ends."""
    ended = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.right("text", F.lit(1)) == ".").alias("ended"))
    t = token_ids(spark, sf_dir).join(ended, "id")
    reject = t.filter("id % 2 = 1").select((F.col("id") - 1).alias("id"), F.col("completion").alias("rejected"), "ended")
    pairs = t.filter("id % 2 = 0").select("id", "prompt", F.col("completion").alias("chosen")).join(reject, "id")
    side = lambda answer, end: ops.preference_side(F.col("prompt"), F.col(answer), end, -1, 1024)
    s = pairs.select("id", side("chosen", F.lit(True)).alias("c"), side("rejected", F.col("ended")).alias("r"))
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return s.select("id", F.size("c.ids").alias("chosen_tokens"), F.size("r.ids").alias("rejected_tokens"), add("c.mask").alias("chosen_loss"), add("r.mask").alias("rejected_loss"), add("c.ids").alias("chosen_sum"), add("r.ids").alias("rejected_sum"))


@query("T16_eos_flag", "SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS eos FROM orders")
def eos_flag(spark, sf_dir):
    """Whether the last of a JSON list of tokens ends the turn; a broken list says no."""
    k = F.col("o_orderkey") % 3
    tokens = F.when(k == 0, '["a","<|im_end|>"]').when(k == 1, '["<|im_end|>","b"]').otherwise("[broken")
    last = F.try_element_at(F.from_json(tokens, "array<string>"), F.lit(-1))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.coalesce(last == "<|im_end|>", F.lit(False)).alias("eos"))


@query("T17_sequence_logprob", "SELECT l_orderkey AS id, round(-sum(l_quantity / 10.0 * (l_linenumber % 2)), 6) AS logprob FROM lineitem GROUP BY 1")
def sequence_logprob(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy(F.col("l_orderkey").alias("id")).agg(F.round(-F.sum(F.col("l_quantity") / 10.0 * (F.col("l_linenumber") % 2)), 6).alias("logprob"))


@query("T18_failure_correction")
def failure_correction(spark, sf_dir):
    """Behind each puzzle's failed guess the bits that it got wrong, with the rule that an example refutes and one that holds: as many of three as fit, or why none is there."""
    kind = "struct<reason:string,corrected:int,text:string>"
    rows = words(spark, sf_dir).withColumn("c", by_puzzles(kind, lambda xs, ys: bitrules.corrections(xs, ys, limit=60)))
    return rows.select("puzzle", "c.*")


@query("T19_category_prefix", f"SELECT id, category || ': \\boxed{{' || answer || '}}' AS target FROM ({OUTPUTS})")
def category_prefix(spark, sf_dir):
    return outputs(spark, sf_dir).select("id", F.concat("category", F.lit(": \\boxed{"), "answer", F.lit("}")).alias("target"))


