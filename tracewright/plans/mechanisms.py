"""Trees, phrase tables, learned merges and scored predictors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import merges, phrases, report, trees
from tracewright.plans.inputs import table
from tracewright.plans.registry import query
from tracewright.sources.files import materialised

#: Documents with objects in arrays in objects, as deep as the id says.
NESTED = """'{"id":' || event_id || ',"props":' || props || ',"tags":["' || event_type || '",' || (user_id % 7) || ',null,true],"deep":' || repeat('{"n":[', CAST(event_id % 6 AS INT)) || '1.5' || repeat(']}', CAST(event_id % 6 AS INT)) || ',"empty":{}}'"""


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(NESTED).alias("doc"))


@query("S13_json_tree", f"""SELECT event_id, fullkey AS path, CAST(len(regexp_extract_all(fullkey, '\\.[a-z]+|\\[\\d+\\]')) AS INT) AS depth,
    CASE type WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' ELSE lower(type) END AS kind, CASE type WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN '{{}}' ELSE CAST(atom AS VARCHAR) END AS value
    FROM (SELECT event_id, {NESTED} AS doc FROM events) e, json_tree(e.doc) t WHERE type NOT IN ('OBJECT', 'ARRAY') OR fullkey = '$.empty'""")
def json_tree(spark, sf_dir):
    """Every leaf of nested documents: path, depth, kind and value."""
    return trees.walk(nested(spark, sf_dir), "event_id", "doc", whole=False)


@query("S13_tree_compare", f"""WITH l AS (SELECT event_id, fullkey AS path, CAST(atom AS VARCHAR) AS v FROM (SELECT event_id, {NESTED} AS doc FROM events) e, json_tree(e.doc) t WHERE type NOT IN ('OBJECT', 'ARRAY')),
    r AS (SELECT event_id, fullkey AS path, CAST(atom AS VARCHAR) AS v FROM (SELECT event_id, {NESTED.replace("user_id % 7", "user_id % 5").replace("event_id % 6", "event_id % 4")} AS doc FROM events) e, json_tree(e.doc) t WHERE type NOT IN ('OBJECT', 'ARRAY'))
    SELECT event_id, path, l.v AS left, r.v AS right, CASE WHEN l.v IS NULL THEN 'added' WHEN r.v IS NULL THEN 'removed' ELSE 'changed' END AS what FROM l FULL JOIN r USING (event_id, path) WHERE l.v IS DISTINCT FROM r.v""")
def tree_compare(spark, sf_dir):
    """What differs between two states of each document, leaf by leaf."""
    other = table(spark, sf_dir, "events").select("event_id", F.expr(NESTED.replace("user_id % 7", "user_id % 5").replace("event_id % 6", "event_id % 4")).alias("doc"))
    return trees.compare(trees.walk(nested(spark, sf_dir), "event_id", "doc", whole=False), trees.walk(other, "event_id", "doc", whole=False), "event_id")


#: Windows of one to six tokens of the benchmark's items, some thousand of them, as phrases.
WINDOWS = r"""SELECT DISTINCT array_to_string(ts[i : i + k - 1], ' ') AS phrase, k FROM (SELECT ts, k, unnest(range(1, len(ts) - k + 2)) AS i
    FROM (SELECT list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS ts FROM benchmark), (SELECT unnest([1, 2, 3, 6]) AS k) WHERE len(ts) >= k)"""
GRAMS = rf"""WITH b AS MATERIALIZED ({WINDOWS}), d AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '') AS ts FROM documents),
    g AS (SELECT doc_id, lang, array_to_string(ts[i : i + k - 1], ' ') AS phrase FROM (SELECT doc_id, lang, ts, k, unnest(range(1, len(ts) - k + 2)) AS i FROM d, (SELECT unnest([1, 2, 3, 6]) AS k) WHERE len(ts) >= k)),
    h AS MATERIALIZED (SELECT doc_id, lang, phrase, count(*) AS n FROM g WHERE phrase IN (SELECT phrase FROM b) GROUP BY 1, 2, 3)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = phrases.tokens_of(F.col("text"))
    of = lambda k: F.when(F.size("ts") >= k, F.transform(F.sequence(F.lit(1), F.size("ts") - k + 1), lambda i: F.array_join(F.slice("ts", i, F.lit(k)), " "))).otherwise(F.array().cast("array<string>"))
    b = table(spark, sf_dir, "benchmark").select(ts.alias("ts"))
    return b.select(F.explode(F.concat(*(of(k) for k in (1, 2, 3, 6)))).alias("phrase")).distinct()


def _hits(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    return phrases.hits_in(table(spark, sf_dir, "documents"), "doc_id", "text", found, "phrase", "phrase")


@query("S18_phrase_index", f"{GRAMS} SELECT b.phrase, count(h.phrase) AS docs, CAST(coalesce(sum(n), 0) AS BIGINT) AS uses FROM b LEFT JOIN h ON b.phrase = h.phrase GROUP BY 1")
def phrase_index(spark, sf_dir):
    """Thousands of phrases counted in all documents, those that are found nowhere too."""
    found = windows(spark, sf_dir)
    return phrases.totals_of(_hits(spark, sf_dir, found), found, "phrase")


@query("A18_phrase_languages", f"{GRAMS} SELECT phrase, lang, count(*) AS docs, CAST(sum(n) AS BIGINT) AS uses FROM h GROUP BY 1, 2")
def phrase_languages(spark, sf_dir):
    """The same phrases by the documents' language: a matrix in long form."""
    found = windows(spark, sf_dir)
    hits = _hits(spark, sf_dir, found)
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return hits.join(langs, "id").groupBy("phrase", "lang").agg(F.count("*").alias("docs"), F.sum("n").alias("uses"))


#: Phrases that a trace mustn't hold, with the document's language where they count (null: everywhere).
FORBIDDEN = [("the", None), ("and the", "en"), ("und", "de"), ("der die", "de"), ("que la", None), ("avec", "fr"), ("con", "es"), ("no such phrase here", None)]


@query("X22_forbidden_table", rf"""WITH f(phrase, scope) AS (VALUES {", ".join(f"('{p}', {'NULL' if lang is None else repr(lang)})" for p, lang in FORBIDDEN)}),
    d AS (SELECT doc_id, lang, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> ''), '  ') || ' ' AS t FROM documents)
    SELECT phrase, count(doc_id) AS docs, CAST(coalesce(sum((length(t) - length(replace(t, ' ' || replace(phrase, ' ', '  ') || ' ', ''))) // (length(replace(phrase, ' ', '  ')) + 2)), 0) AS BIGINT) AS uses
    FROM f LEFT JOIN d ON contains(t, ' ' || replace(phrase, ' ', '  ') || ' ') AND (scope IS NULL OR lang = scope) GROUP BY 1""")
def forbidden_table(spark, sf_dir):
    """Forbidden phrases from a table, some for one language alone, by the index."""
    found = spark.createDataFrame(FORBIDDEN, "phrase string, scope string")
    hits = _hits(spark, sf_dir, found).join(F.broadcast(found), "phrase")
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    counted = hits.join(langs, "id").filter("scope IS NULL OR lang = scope").groupBy("phrase").agg(F.count("*").alias("docs"), F.sum("n").alias("uses"))
    return found.select("phrase").join(counted, "phrase", "left").select("phrase", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("uses", F.lit(0)).alias("uses"))


#: Merges that are learned of the documents; the number is the operator's parameter.
LEARNED = 64


def _learned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    counted = materialised(merges.words(table(spark, sf_dir, "documents"), "text"), "words")
    return counted, merges.learn(counted, LEARNED)


@query("A22_learned_merges")
def learned_merges(spark, sf_dir):
    """The first merges of the documents' words and how often each pair stood when its turn came; tests hold them against a plain loop."""
    return _learned(spark, sf_dir)[1]


@query("A22_merge_dictionary")
def merge_dictionary(spark, sf_dir):
    """Merged symbols as they stand in the words in the end: uses, distinct words with it (counted by place), bytes."""
    counted, found = _learned(spark, sf_dir)
    return merges.dictionary(counted, found).withColumn("size", F.octet_length("symbol"))


@query("P11_learned_symbols")
def learned_symbols(spark, sf_dir):
    """P11 and P12 with learned merges: the merged symbols of each benchmark item in the order of their first appearance, and how many there are."""
    _, found = _learned(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"[\x20\x09-\x0D]+")).alias("at", "word"))
    cut = merges.segmented(items.filter("word <> ''"), "word", found)
    parts = cut.select("item_id", "at", F.posexplode("symbols").alias("in_word", "symbol")).filter(merges.is_merged(F.col("symbol")))
    firsts = parts.groupBy("item_id", "symbol").agg(F.min(F.struct("at", "in_word")).alias("first"), F.count("*").alias("n"))
    return firsts.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "symbol"))), lambda x: x["symbol"]), " ").alias("fused"), F.count("*").alias("distinct"), F.sum("n").alias("uses"))


#: What a fallback may look at: nothing, the source, the length, both.
PREDICTORS = {"mode": [], "mode by source": ["source"], "mode by length": ["size"], "mode by source and length": ["source", "size"]}


@query("K36_scored_fallbacks", """WITH d AS (SELECT lang AS v, coalesce(source, '') AS source, n_chars // 500 AS size FROM documents WHERE lang IS NOT NULL),
    g AS (SELECT 'mode' AS predictor, '' AS g, v FROM d UNION ALL SELECT 'mode by source', source, v FROM d UNION ALL SELECT 'mode by length', CAST(size AS VARCHAR), v FROM d UNION ALL SELECT 'mode by source and length', source || '|' || size, v FROM d),
    c AS (SELECT predictor, g, v, count(*) AS n FROM g GROUP BY ALL),
    t AS (SELECT a.predictor, a.g, a.v, a.n, b.v AS said, row_number() OVER (PARTITION BY a.predictor, a.g, a.v ORDER BY b.n - CAST(a.v = b.v AS INT) DESC, b.v) AS k
        FROM c a LEFT JOIN c b ON a.predictor = b.predictor AND a.g IS NOT DISTINCT FROM b.g AND b.n - CAST(a.v = b.v AS INT) > 0),
    s AS (SELECT predictor, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (said IS NOT NULL), 0) AS BIGINT) AS told, CAST(coalesce(sum(n) FILTER (said = v), 0) AS BIGINT) AS hits FROM t WHERE k = 1 GROUP BY 1)
    SELECT predictor, rows, told, hits, round(hits / told, 6) AS accuracy, CAST(row_number() OVER (ORDER BY hits DESC, predictor) AS INT) AS rank FROM s""")
def scored_fallbacks(spark, sf_dir):
    """Fallbacks scored by leaving each row out, and ranked."""
    d = table(spark, sf_dir, "documents").select("lang", F.coalesce("source", F.lit("")).alias("source"), F.floor(F.col("n_chars") / 500).alias("size"))
    return report.leave_one_out(d, "lang", PREDICTORS)
