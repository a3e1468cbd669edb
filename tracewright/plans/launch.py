"""Types of prompts, launch filters, prefix tables and preference arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import trainset as ops
from tracewright.plans.inputs import table
from tracewright.plans.registry import query
from tracewright.plans.training import IDS, _SIDES, token_ids

# What a prompt says of each type of puzzle, in the order in which types are tried.
TYPES = {
    "Number Base Conversion": "numeral system|base[- ]?\\d|number.*convert|radix|secret number|roman",
    "Gravitational Constant": "gravit|gravity|falling|free.?fall|acceleration due to",
    "Equation Transformation": "transformation rule|equation.*transform|secret.*rule.*equation|rule.*applied.*equation",
    "Text Encryption": "encrypt|cipher|secret.*code.*letter|coded.*message|secret.*text|decrypt",
    "Bit Manipulation": "bit.?manipul|binary|8.?bit|bitwise|bit.*transform",
    "Unit Conversion": "unit.?conver|measurement|becomes.*\\d|secret.*conver.*measur",
}
#: Prompts of all types and of two at once, by the remainder of a document's length.
OPENINGS = [
    "Write it in ROMAN numerals: ", "An object is Falling freely: ", "Find the transformation rule; base 10: ", "Decrypt the coded message: ", "An 8-bit number under a transformation rule: ", "A secret unit conversion: ", "12 becomes 7: ", "Tell me of ", "a rule was applied to this equation: ", "a measurement of gravity: ",
]
_CASES = " ".join(f"WHEN regexp_matches(p, '{r}') THEN '{n}'" for n, r in TYPES.items())
_PROMPT = f"CASE length(text) % {len(OPENINGS)} {' '.join(f'WHEN {i} THEN {chr(39)}{o}{chr(39)}' for i, o in enumerate(OPENINGS))} END || substr(text, 1, 60)"


@query("X21_puzzle_types", f"SELECT id, CASE {_CASES} ELSE 'Unknown' END AS kind FROM (SELECT doc_id AS id, lower({_PROMPT}) AS p FROM documents WHERE text IS NOT NULL)")
def puzzle_types(spark, sf_dir):
    """The first of six types whose pattern a prompt holds."""
    opening = F.get(F.array(*map(F.lit, OPENINGS)), F.length("text") % len(OPENINGS))
    p = F.lower(F.concat(opening, F.substring("text", 1, 60)))
    kind = F.coalesce(*(F.when(F.regexp_like("p", F.lit(r)), n) for n, r in TYPES.items()), F.lit("Unknown"))
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), p.alias("p")).select("id", kind.alias("kind"))


#: Sources that are trained on, and the most words of a trace and characters of a prompt.
KEPT, TRACE, PROMPT = [f"src{i}" for i in range(12)], 600, 6000


@query("V8_launch_reasons", f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN coalesce(text, '') = '' OR coalesce(lang, '') = '' THEN '1 no prompt or answer' WHEN coalesce(source, '') NOT IN ({", ".join(f"'{k}'" for k in KEPT)}) THEN '2 not in a category'
        WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) > {TRACE} THEN '3 trace too long' WHEN length(text) + 40 > {PROMPT} THEN '4 prompt too long' ELSE '5 kept' END AS reason FROM documents) GROUP BY 1""")
def launch_reasons(spark, sf_dir):
    """The first reason for which a row isn't launched, counted, and how many stay."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    reason = (
        F.when((F.coalesce("text", F.lit("")) == "") | (F.coalesce("lang", F.lit("")) == ""), "1 no prompt or answer").when(~F.coalesce("source", F.lit("")).isin(KEPT), "2 not in a category")
        .when(words > TRACE, "3 trace too long").when(F.length("text") + 40 > PROMPT, "4 prompt too long").otherwise("5 kept")
    )
    return table(spark, sf_dir, "documents").select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("T6_prefix_tables", " UNION ALL ".join(f"SELECT {k} AS k, md5(array_to_string(completion[:{k}], ',')) AS prefix, max(id) AS id, count(*) AS n FROM ({IDS}) WHERE len(completion) >= {k} GROUP BY 2" for k in (8, 50)))
def prefix_tables(spark, sf_dir):
    """Rows by their first 8 and first 50 ids, the last row of each prefix, collisions counted; both tables in one pass."""
    t = token_ids(spark, sf_dir).select("id", "completion")
    each = t.select("id", "completion", F.explode(F.array(F.lit(8), F.lit(50))).alias("k")).filter(F.size("completion") >= F.col("k"))
    prefix = F.md5(F.array_join(F.slice("completion", F.lit(1), F.col("k")), ",").cast("binary"))
    return each.groupBy("k", prefix.alias("prefix")).agg(F.max("id").alias("id"), F.count("*").alias("n"))


@query("T12_top_losses", f"SELECT id, round(list_avg(list_reverse_sort(ce)[:32]), 6) AS top32, len(ce) AS n FROM (SELECT id, list_transform(completion, lambda x: x / 7.0) AS ce FROM ({IDS})) WHERE len(ce) > 0")
def top_losses(spark, sf_dir):
    """The mean of the 32 largest losses of a sequence, or of all where there are fewer."""
    ce = F.transform("completion", lambda x: x / F.lit(7.0))
    top = F.slice(F.reverse(F.array_sort("ce")), 1, 32)
    c = token_ids(spark, sf_dir).select("id", ce.alias("ce")).filter(F.size("ce") > 0)
    return c.select("id", F.round(ops.mean_loss(top, F.transform(top, lambda x: F.lit(1.0))), 6).alias("top32"), F.size("ce").cast("long").alias("n"))


@query("T15_preference_arrays", f"""WITH s AS ({_SIDES}), p AS (SELECT c.id, c.prompt, c.completion AS chosen, r.completion AS rejected, r.ended FROM s c JOIN s r ON c.id % 2 = 0 AND r.id = c.id + 1),
    i AS (SELECT id, len(prompt) AS n, (prompt || chosen || [-1])[:1024] AS c, (prompt || rejected || CASE WHEN ended THEN [-1] ELSE [] END)[:1024] AS r FROM p)
    SELECT id, side, md5(array_to_string(ids, ',')) AS ids, md5(array_to_string(list_transform(range(1, len(ids) + 1), lambda k: CASE WHEN k <= n THEN 0 ELSE 1 END), ',')) AS mask FROM (SELECT id, n, 'chosen' AS side, c AS ids FROM i UNION ALL SELECT id, n, 'rejected', r FROM i)""")
def preference_arrays(spark, sf_dir):
    """Every id and mask of both sides of preference pairs, by their digests."""
    ended = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.right("text", F.lit(1)) == ".").alias("ended"))
    t = token_ids(spark, sf_dir).join(ended, "id")
    reject = t.filter("id % 2 = 1").select((F.col("id") - 1).alias("id"), F.col("completion").alias("rejected"), "ended")
    pairs = t.filter("id % 2 = 0").select("id", "prompt", F.col("completion").alias("chosen")).join(reject, "id")
    side = lambda answer, end: ops.preference_side(F.col("prompt"), F.col(answer), end, -1, 1024)
    both = pairs.select("id", F.explode(F.array(F.struct(F.lit("chosen").alias("side"), side("chosen", F.lit(True)).alias("x")), F.struct(F.lit("rejected").alias("side"), side("rejected", F.col("ended")).alias("x")))).alias("s"))
    digest = lambda c: F.md5(F.array_join(c, ",").cast("binary"))
    return both.select("id", "s.side", digest(F.col("s.x.ids")).alias("ids"), digest(F.col("s.x.mask")).alias("mask"))
