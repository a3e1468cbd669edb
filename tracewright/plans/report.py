"""Aggregate reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.operators import report as ops
from tracewright.operators.ranges import running
from tracewright.plans.inputs import CORPUS, corpus, table
from tracewright.plans.registry import query


@query("A1_value_counts", "SELECT source AS value, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS place FROM documents GROUP BY 1")
def value_counts(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("value")).agg(F.count("*").alias("n"))
    return g.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"))).cast("long"))


@query("A4_length_stats", "SELECT lang, CAST(min(length(text)) AS INT) AS low, CAST(max(length(text)) AS INT) AS high, round(avg(length(text)), 4) AS mean FROM documents GROUP BY 1")
def length_stats(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.min(n).alias("low"), F.max(n).alias("high"), F.round(F.avg(n), 4).alias("mean"))


@query("A5_index_quantiles", "SELECT l_returnflag AS k, l[1] AS low, l[CAST(floor(len(l) * 0.5) AS INT) + 1] AS med, l[CAST(floor(len(l) * 0.9) AS INT) + 1] AS p90, l[CAST(floor(len(l) * 0.99) AS INT) + 1] AS p99, l[-1] AS high FROM (SELECT l_returnflag, list_sort(list(CAST(l_quantity AS INT))) AS l FROM lineitem GROUP BY 1)")
def index_quantiles(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").cast("int").alias("v"))
    return ops.index_quantile(l, ["k"], "v", {"low": 0.0, "med": 0.5, "p90": 0.9, "p99": 0.99, "high": 1.0})


@query("A6_exclusive_quartiles", """WITH t AS (SELECT p_brand AS k, list_sort(list(p_size)) AS l FROM part GROUP BY 1), q AS (SELECT k, l, unnest([1, 2, 3]) AS i FROM t), j AS (SELECT *, greatest(1, least(len(l) - 1, (i * (len(l) + 1)) // 4)) AS j FROM q WHERE len(l) > 1)
    SELECT k, i, round((l[j] * (4 - (i * (len(l) + 1) - 4 * j)) + l[j + 1] * (i * (len(l) + 1) - 4 * j)) / 4.0, 6) AS q FROM j""")
def exclusive_quartiles(spark, sf_dir):
    """Cuts at (n + 1) p with interpolation, as the exclusive method has them."""
    c = ops.counted_places(table(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), "p_size"), ["k"], "p_size").filter("__all > 1")
    n = F.col("__all")
    place = lambda i: F.greatest(F.lit(1), F.least(n - 1, F.floor(i * (n + 1) / 4)))
    g = c.groupBy("k").agg(F.max("__all").alias("__all"), *(x for i in (1, 2, 3) for x in (ops.nth("p_size", place(i) - 1).alias(f"a{i}"), ops.nth("p_size", place(i)).alias(f"b{i}"))))
    cut = lambda i: (F.col(f"a{i}") * (4 - (i * (n + 1) - 4 * place(i))) + F.col(f"b{i}") * (i * (n + 1) - 4 * place(i))) / 4.0
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.round(cut(i), 6).alias("q")) for i in (1, 2, 3))))
    return g.select("k", each.alias("r")).select("k", "r.i", "r.q")


@query("A7_median_mean", "SELECT o_orderstatus AS k, median(floor(o_totalprice)) AS med, round(avg(floor(o_totalprice)), 4) AS mean FROM orders GROUP BY 1")
def median_mean(spark, sf_dir):
    """The mean of the two middle values, found by their places."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("k"), F.floor("o_totalprice").alias("p"))
    c, n = ops.counted_places(o, ["k"], "p"), F.col("__all")
    middle = (ops.nth("p", F.floor((n - 1) / 2)) + ops.nth("p", F.floor(n / 2))) / 2.0
    return c.groupBy("k").agg(middle.alias("med"), F.round(F.sum(F.col("p") * F.col("__n")) / F.sum("__n"), 4).alias("mean"))


@query("A8_tercile_bands", "WITH c AS (SELECT l[len(l) // 3 + 1] AS a, l[2 * len(l) // 3 + 1] AS b FROM (SELECT list_sort(list(p_size)) AS l FROM part)) SELECT CASE WHEN p_size <= a THEN 'low' WHEN p_size <= b THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM part, c GROUP BY 1")
def tercile_bands(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_size", F.lit(1).alias("one"))
    cuts = ops.index_quantile(p, ["one"], "p_size", {"a": 1 / 3, "b": 2 / 3})
    banded = p.join(F.broadcast(cuts), "one")  # cuts is one row
    return banded.groupBy(F.when(F.col("p_size") <= F.col("a"), "low").when(F.col("p_size") <= F.col("b"), "mid").otherwise("high").alias("band")).agg(F.count("*").alias("n"))


AXES = ["category", "label", "origin", "gt_match"]


@query("A9_axis_distribution", f"SELECT axis, value, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY axis), 1) AS pct FROM (SELECT * FROM (SELECT id, category, label, origin, gt_match FROM ({CORPUS})) UNPIVOT (value FOR axis IN (category, label, origin, gt_match))) GROUP BY 1, 2")
def axis_distribution(spark, sf_dir):
    long = corpus(spark, sf_dir).select("id", *AXES).unpivot("id", AXES, "axis", "value")
    g = long.groupBy("axis", "value").agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("axis")), 1))


RATES = f"SELECT category, sum(w * gold) / nullif(sum(w), 0) AS gold, sum(w * matched) / nullif(sum(w), 0) AS matched FROM (SELECT category, CAST(oversampling AS INT) AS w, CAST(origin = 'gold' AS INT) AS gold, CAST(gt_match = 'True' AS INT) AS matched FROM ({CORPUS})) GROUP BY 1"


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("oversampling").cast("int")
    return corpus(spark, sf_dir).groupBy("category").agg(ops.rate(F.col("origin") == "gold", w).alias("gold"), ops.rate(F.col("gt_match") == "True", w).alias("matched"))


@query("A10_weighted_rates", f"SELECT category, round(gold, 6) AS gold, round(matched, 6) AS matched FROM ({RATES})")
def weighted_rates(spark, sf_dir):
    return rates(spark, sf_dir).select("category", F.round("gold", 6).alias("gold"), F.round("matched", 6).alias("matched"))


@query("A11_decorrelation", f"SELECT round(max(gold) - min(gold), 6) AS gold, round(max(matched) - min(matched), 6) AS matched FROM ({RATES})")
def decorrelation(spark, sf_dir):
    return rates(spark, sf_dir).agg(*(F.round(F.max(c) - F.min(c), 6).alias(c) for c in ("gold", "matched")))


@query("A12_group_means", "SELECT l_shipdate < '1996-01-01' AS early, round(avg(CAST(l_quantity AS INT)), 4) AS quantity, round(avg(l_linenumber), 4) AS line FROM lineitem GROUP BY 1")
def group_means(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp")).alias("early")).agg(F.round(F.avg(F.col("l_quantity").cast("int")), 4).alias("quantity"), F.round(F.avg("l_linenumber"), 4).alias("line"))


@query("A13_contingency", "SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY 1")
def contingency(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.count(F.lit(1))).fillna(0)


@query("A14_pivot_mean", "SELECT o_orderstatus AS status, o_orderpriority AS priority, round(coalesce(avg(CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 10 END), 0), 6) AS a, round(coalesce(avg(CASE WHEN o_custkey % 3 = 1 THEN o_orderkey % 10 END), 0), 6) AS b FROM orders GROUP BY 1, 2")
def pivot_mean(spark, sf_dir):
    """Cells are means, missing ones 0."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), (F.col("o_custkey") % 3).alias("c"), (F.col("o_orderkey") % 10).alias("v"))
    p = o.groupBy("status", "priority").pivot("c", [0, 1]).agg(F.avg("v")).fillna(0.0)
    return p.select("status", "priority", F.round("0", 6).alias("a"), F.round("1", 6).alias("b"))


RUNS = "SELECT doc_id AS id, lang, doc_id % 3 = 0 AS r1, doc_id % 3 = 0 OR doc_id % 7 = 0 AS r2, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 5 = 0 END AS r3, length(text) AS t1, length(text) + doc_id % 50 AS t2 FROM documents"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(d.alias("id"), "lang", (d % 3 == 0).alias("r1"), ((d % 3 == 0) | (d % 7 == 0)).alias("r2"), F.when(d % 11 != 0, d % 5 == 0).alias("r3"), F.length("text").alias("t1"), (F.length("text") + d % 50).alias("t2"))


@query("A15_flips", f"SELECT id FROM ({RUNS}) WHERE len(list_distinct(list_filter([r1, r2, r3], lambda x: x IS NOT NULL))) > 1")
def flips(spark, sf_dir):
    return runs(spark, sf_dir).filter(ops.flips([F.col("r1"), F.col("r2"), F.col("r3")])).select("id")


@query("A16_wins_losses", f"SELECT lang, CAST(sum(CAST(r2 AND NOT r1 AS INT)) AS BIGINT) AS wins, CAST(sum(CAST(r1 AND NOT r2 AS INT)) AS BIGINT) AS losses, CAST(sum(CAST(r2 AS INT) - CAST(r1 AS INT)) AS BIGINT) AS net FROM ({RUNS}) GROUP BY 1")
def wins_losses(spark, sf_dir):
    one = lambda c: F.sum(c.cast("int"))
    a, b = F.col("r1"), F.col("r2")
    return runs(spark, sf_dir).groupBy("lang").agg(one(b & ~a).alias("wins"), one(a & ~b).alias("losses"), (one(b) - one(a)).alias("net"))


@query("A17_length_delta", f"SELECT lang, round(avg(t1), 4) AS base, round(avg(t2) - avg(t1), 4) AS delta FROM ({RUNS}) GROUP BY 1")
def length_delta(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("lang").agg(F.round(F.avg("t1"), 4).alias("base"), F.round(F.avg("t2") - F.avg("t1"), 4).alias("delta"))


@query("A18_phrase_matrix", "SELECT lang, phrase, CAST(sum(CAST(contains(text, phrase) AS INT)) AS BIGINT) AS n FROM documents, (SELECT unnest(['the', 'der', 'que']) AS phrase) GROUP BY 1, 2")
def phrase_matrix(spark, sf_dir):
    words = ["the", "der", "que"]
    g = table(spark, sf_dir, "documents").groupBy("lang").agg(*(F.sum(F.contains("text", F.lit(p)).cast("int")).alias(p) for p in words))
    return g.unpivot("lang", words, "phrase", "n")


@query("A19_interesting_flips", f"SELECT id, CAST(t1 AS INT) AS t1 FROM ({RUNS}) WHERE r2 AND NOT r1 ORDER BY t1 DESC, id LIMIT 5")
def interesting_flips(spark, sf_dir):
    """A top-k: the limit is the operator."""
    return runs(spark, sf_dir).filter("r2 AND NOT r1").select("id", "t1").orderBy(F.desc("t1"), "id").limit(5)


@query("A20_cover_report", "WITH t AS (SELECT DISTINCT p_partkey % 2 = 0 AS kept, unnest(string_split(p_name, '')) AS c FROM part), a AS (SELECT DISTINCT c FROM t), k AS (SELECT DISTINCT c FROM t WHERE kept) SELECT (SELECT count(*) FROM a) AS achievable, (SELECT count(*) FROM k) AS kept, (SELECT count(*) FROM a) - (SELECT count(*) FROM k) AS lost")
def cover_report(spark, sf_dir):
    t = table(spark, sf_dir, "part").select((F.col("p_partkey") % 2 == 0).alias("kept"), F.explode(F.split("p_name", "")).alias("c"))
    g = t.agg(F.countDistinct("c").alias("achievable"), F.countDistinct(F.when(F.col("kept"), F.col("c"))).alias("kept"))
    return g.withColumn("lost", F.col("achievable") - F.col("kept"))


@query("A21_symbol_frequency", "SELECT s, coalesce(n, 0) AS n, n IS NULL AS missing FROM (SELECT unnest(string_split('0123456789+-*/#%', '')) AS s) LEFT JOIN (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(c_name, '')) AS c FROM customer) GROUP BY 1) ON s = c")
def symbol_frequency(spark, sf_dir):
    alphabet = spark.createDataFrame([(c,) for c in "0123456789+-*/#%"], "s string")
    n = table(spark, sf_dir, "customer").select(F.explode(F.split("c_name", "")).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    return alphabet.join(n, "s", "left").select("s", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


@query("A22_token_dictionary", "SELECT length(t) AS size, count(*) AS tokens, CAST(sum(n) AS BIGINT) AS uses FROM (SELECT t, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS t FROM part) GROUP BY 1) GROUP BY 1")
def token_dictionary(spark, sf_dir):
    t = table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    return t.groupBy(F.length("t").cast("long").alias("size")).agg(F.count("*").alias("tokens"), F.sum("n").alias("uses"))


@query("A23_pass_at_k", "SELECT l_orderkey AS id, CAST(sum(CAST(l_returnflag = 'R' AS INT)) AS BIGINT) AS n_correct, bool_or(l_returnflag = 'R') AS passed, round(avg(CAST(l_returnflag = 'R' AS INT)), 6) AS mean, list_sort(list(CAST(l_quantity AS INT)))[len(list(l_quantity)) // 2 + 1] AS median FROM lineitem GROUP BY 1")
def pass_at_k(spark, sf_dir):
    """The median is the upper one of the middle; a puzzle's samples are few."""
    hit = F.col("l_returnflag") == "R"
    q = F.array_sort(F.collect_list(F.col("l_quantity").cast("int")))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum(hit.cast("int")).alias("n_correct"), F.bool_or(hit).alias("passed"), F.round(F.avg(hit.cast("int")), 6).alias("mean"), F.element_at(q, F.floor(F.size(q) / 2).cast("int") + 1).alias("median"))


@query("A24_costs", "SELECT role, CAST(sum(length(text)) AS BIGINT) AS chars, round(sum(length(text)) * 0.25 / 1000000, 9) AS cost FROM conversations GROUP BY 1")
def costs(spark, sf_dir):
    n = F.sum(F.length("text"))
    return table(spark, sf_dir, "conversations").groupBy("role").agg(n.alias("chars"), F.round(n * 0.25 / 1000000, 9).alias("cost"))


@query("A25_audit", "SELECT count(*) AS n, round(avg(s), 4) AS mean, count(*) FILTER (s = 10) AS ten, count(*) FILTER (s BETWEEN 7 AND 9) AS good, count(*) FILTER (s BETWEEN 4 AND 6) AS fair, count(*) FILTER (s <= 3) AS poor FROM (SELECT o_orderkey % 11 AS s FROM orders)")
def audit(spark, sf_dir):
    s = F.col("o_orderkey") % 11
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.round(F.avg(s), 4).alias("mean"), F.count_if(s == 10).alias("ten"), F.count_if(s.between(7, 9)).alias("good"), F.count_if(s.between(4, 6)).alias("fair"), F.count_if(s <= 3).alias("poor"))


@query("A26_match_yield", f"SELECT category, label, count(*) AS n, CAST(sum(CAST(gt_match = 'True' AS INT)) AS BIGINT) AS matched FROM ({CORPUS}) GROUP BY 1, 2")
def match_yield(spark, sf_dir):
    return corpus(spark, sf_dir).groupBy("category", "label").agg(F.count("*").alias("n"), F.sum((F.col("gt_match") == "True").cast("int")).alias("matched"))


@query("A27_regeneration_diff", f"SELECT CAST(sum(CAST(r1 <> r2 AS INT)) AS BIGINT) AS changed, CAST(sum(CAST(r2 AND NOT r1 AS INT)) AS BIGINT) AS gained, CAST(sum(t2 - t1) AS BIGINT) AS tokens FROM ({RUNS})")
def regeneration_diff(spark, sf_dir):
    r = runs(spark, sf_dir)
    before, after = r.select("id", "r1", "t1"), r.select("id", "r2", "t2")
    return before.join(after, "id").agg(F.sum((F.col("r1") != F.col("r2")).cast("int")).alias("changed"), F.sum((F.col("r2") & ~F.col("r1")).cast("int")).alias("gained"), F.sum(F.col("t2") - F.col("t1")).alias("tokens"))


@query("A28_keep_rates", f"SELECT label, count(*) AS n, count(*) FILTER (CAST(token_length AS INT) < 500 AND gt_match = 'True') AS under, count(*) FILTER (CAST(token_length AS INT) >= 500 AND gt_match = 'True') AS over FROM ({CORPUS}) GROUP BY 1")
def keep_rates(spark, sf_dir):
    t, m = F.col("token_length").cast("int"), F.col("gt_match") == "True"
    return corpus(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.count_if((t < 500) & m).alias("under"), F.count_if((t >= 500) & m).alias("over"))


@query("A29_routing", "SELECT layer, expert, count(*) AS n FROM (SELECT l_linenumber AS layer, unnest([l_partkey % 8, l_suppkey % 8]) AS expert FROM lineitem) GROUP BY 1, 2")
def routing(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("layer"), F.explode(F.array(F.col("l_partkey") % 8, F.col("l_suppkey") % 8)).alias("expert"))
    return l.groupBy("layer", "expert").agg(F.count("*").alias("n"))


@query("A30_loop_statistics", "SELECT batch, n, CAST(sum(n) OVER (ORDER BY batch) AS BIGINT) AS done, round(sum(n) OVER (ORDER BY batch) * 1.0 / (batch + 1), 6) AS rate FROM (SELECT o_orderkey // 64 AS batch, count(*) AS n FROM orders GROUP BY 1)")
def loop_statistics(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 64).alias("batch")).agg(F.count("*").alias("n"))
    placed = running(g.withColumn("__all", F.lit(0)), "__all", ["batch"], F.floor(F.col("batch") / 1024), F.col("n"), "before")
    done = F.col("before") + F.col("n")
    return placed.select("batch", "n", done.alias("done"), F.round(done * 1.0 / (F.col("batch") + 1), 6).alias("rate"))


@query("A31_histogram", "WITH e AS (SELECT min(length(text)) AS low, max(length(text)) AS high FROM documents) SELECT CAST(least(59, floor((length(text) - low) / greatest(high - low, 1) * 60)) AS INT) AS bin, count(*) AS n FROM documents, e GROUP BY 1")
def histogram(spark, sf_dir):
    return ops.histogram(table(spark, sf_dir, "documents").select(F.length("text").alias("v")).filter("v IS NOT NULL"), "v", 60)


TENSORS = "SELECT label AS step, i, j, CAST(round(v * 1000) AS BIGINT) AS v FROM (SELECT label, vec_id % 4 AS i, j, embedding[j] AS v FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS j FROM embeddings))"


@query("A32_tensor_average", f"SELECT i, j, round(sum(v * (step + 1)) * 1.0 / sum(step + 1), 4) AS v FROM ({TENSORS}) GROUP BY 1, 2")
def tensor_average(spark, sf_dir):
    """A weighted mean of matrices in long form."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("step"), (F.col("vec_id") % 4).alias("i"), F.posexplode("embedding").alias("j", "v"))
    w = F.col("step") + 1
    e = e.withColumn("v", F.round(F.col("v").cast("float") * 1000).cast("long")).withColumn("j", (F.col("j") + 1).cast("long"))
    return e.groupBy("i", "j").agg(F.round(F.sum(F.col("v") * w) * 1.0 / F.sum(w), 4).alias("v"))


@query("A33_low_rank_merge")
def low_rank_merge(spark, sf_dir):
    """Low-rank factors of the mean of products B A of several snapshots, for each module."""
    from tracewright.operators import merge

    e = table(spark, sf_dir, "embeddings")
    f = e.select((F.col("vec_id") % 2).alias("module"), (F.floor(F.col("vec_id") / 2) % 3).alias("step"), F.floor(F.col("vec_id") / 6).cast("int").alias("k"), F.col("embedding"))
    return merge.svd_merge(f, rank=4)


@query("K36_fallback_modes", "SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS k FROM documents GROUP BY 1, 2) WHERE k = 1")
def fallback_modes(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return g.groupBy("source").agg(F.max_by("lang", F.struct("n", F.translate("lang", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"))).alias("lang"))
