"""Sampling, quotas and curricula."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.operators import balance as ops
from tracewright.operators.corpus import hash_order, ranked_by_pieces
from tracewright.operators.ranges import in_ranges, tile
from tracewright.plans.inputs import CORPUS, corpus, table
from tracewright.plans.registry import query
from tracewright.sources.files import materialised

MD5 = "md5('{}|' || id)"
UNIFORM = "(CAST(('0x' || substr(md5('{}|' || id), 1, 13)) AS BIGINT) / 4503599627370496.0)"


@query("B7_quota_fill", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY category, origin ORDER BY {MD5.format(1)}, id) AS place FROM ({CORPUS})),
    k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY CAST(place > 6 AS INT), {MD5.format(1)}, id) AS k FROM r) SELECT id, category, origin FROM k WHERE k <= 12""")
def quota_fill(spark, sf_dir):
    c = corpus(spark, sf_dir).select("id", "category", "origin", hash_order(1, "id").alias("h"))
    goal = c.select("category").distinct().withColumn("target", F.lit(12))
    return ops.quota_fill(c, ["category"], "origin", ["h", "id"], goal).select("id", "category", "origin")


@query("B8_deficit", f"SELECT label, greatest(0, CAST(round_even(500 * 0.3, 0) AS BIGINT) - count(*)) AS deficit FROM ({CORPUS}) GROUP BY 1")
def deficit(spark, sf_dir):
    return corpus(spark, sf_dir).groupBy("label").agg(F.greatest(F.lit(0), F.bround(F.lit(500 * 0.3)).cast("long") - F.count("*")).alias("deficit"))


#: Cover, turns and rest of a group by a recursive statement: each step of it takes a row for the rarest item that isn't covered.
COVER = """WITH RECURSIVE t AS (SELECT p_partkey AS id, p_brand AS brand, p_type AS kind, list_distinct(string_split(p_name, '')) AS items FROM part),
    n AS (SELECT brand, item, count(*) AS n FROM (SELECT brand, unnest(items) AS item FROM t) GROUP BY 1, 2),
    o AS (SELECT brand, list(item ORDER BY n, item) AS ord FROM n GROUP BY 1),
    c AS (SELECT brand, ord, CAST([] AS VARCHAR[]) AS covered, CAST(NULL AS BIGINT) AS id, 0 AS place FROM o
        UNION ALL
        SELECT brand, ord, list_distinct(list_concat(covered, items)), id, place + 1 FROM (
            SELECT c.brand, c.ord, c.covered, c.place, t.id, t.items, row_number() OVER (PARTITION BY c.brand ORDER BY len(list_filter(t.items, lambda x: NOT list_contains(c.covered, x))) DESC, t.id) AS k
            FROM c JOIN t ON t.brand = c.brand AND list_contains(t.items, list_filter(c.ord, lambda x: NOT list_contains(c.covered, x))[1]) WHERE c.place < 50) WHERE k = 1),
    h AS (SELECT brand, id FROM c WHERE place > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY brand, kind ORDER BY id) AS turn FROM t WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.brand = t.brand AND h.id = t.id)),
    f AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY CAST(turn > 1 AS INT), CASE WHEN turn = 1 THEN kind END, id) AS k FROM r)
    SELECT brand, id, 1 AS phase FROM h UNION ALL
    SELECT f.brand, f.id, CASE WHEN turn = 1 THEN 2 ELSE 3 END FROM f LEFT JOIN (SELECT brand, count(*) AS have FROM h GROUP BY 1) g ON f.brand = g.brand WHERE k + coalesce(have, 0) <= 50"""


@query("B9_set_cover", COVER)
def set_cover(spark, sf_dir):
    """Cover of name letters within a brand, then types in turn, then the rest, up to a quota."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.array_distinct(F.split("p_name", "")).alias("items"))
    return ops.cover_then_fill(p, "id", "items", "brand", "kind", 50)


@query("B10_round_robin_fill", f"""WITH r AS (SELECT id, category, label, row_number() OVER (PARTITION BY category, label ORDER BY id) AS turn, count(*) OVER (PARTITION BY category, label) AS size FROM ({CORPUS}))
    SELECT id, category, label FROM r ORDER BY turn, size DESC, category, label, id LIMIT 100""")
def round_robin_fill(spark, sf_dir):
    return ops.round_robin_fill(corpus(spark, sf_dir).select("id", "category", "label"), ["category", "label"], ["id"], 100)


TERCILES = f"""WITH c AS (SELECT id, category, label, CAST(token_length AS INT) AS n, ntile(3) OVER (PARTITION BY category ORDER BY CAST(token_length AS INT), id) AS band FROM ({CORPUS})),
    p AS (SELECT * FROM c WHERE {UNIFORM.format(9)} < CASE band WHEN 1 THEN 0.8 WHEN 2 THEN 0.55 ELSE 0.15 END),
    f AS (SELECT *, row_number() OVER (PARTITION BY category, label, band ORDER BY n, id) AS k FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.category = c.category AND p.label = c.label AND p.band = c.band))
    SELECT id, band, 'rate' AS why FROM p UNION ALL SELECT id, band, 'floor' FROM f WHERE k = 1"""


@query("B11_tercile_rates", TERCILES)
def tercile_rates(spark, sf_dir):
    """Rates by tercile of length within a category, then the shortest row of each cell (category, label, band) that got none."""
    c = corpus(spark, sf_dir).select("id", "category", "label", F.col("token_length").cast("int").alias("n"))
    sizes = c.groupBy("category").agg(F.count("*").alias("rows"))
    # ranges of (category, n, id): a length that most rows have is spread too
    ranked = ranked_by_pieces(in_ranges(c, ["category", "n", "id"]), ["category"], ["n", "id"], F.col("__piece")).join(sizes, "category")
    banded = materialised(ranked.withColumn("band", tile(F.col("rank") - 1, F.col("rows"), 3)).select("id", "category", "label", "n", "band"))
    rate = F.when(F.col("band") == 1, 0.8).when(F.col("band") == 2, 0.55).otherwise(0.15)
    picked = banded.filter(ops.hash_uniform(9, "id") < rate)
    cell = ["category", "label", "band"]
    empty = banded.join(picked.select(*cell).distinct(), cell, "left_anti").groupBy(*cell).agg(F.min(F.struct("n", "id")).alias("first"))
    return picked.select("id", "band", F.lit("rate").alias("why")).unionByName(empty.select("first.id", "band", F.lit("floor").alias("why")))


@query("B12_curriculum", f"SELECT CASE WHEN CAST(token_length AS INT) < 200 THEN 1 WHEN CAST(token_length AS INT) < 800 THEN 2 ELSE 3 END AS stage, count(*) AS n FROM ({CORPUS}) GROUP BY 1")
def curriculum(spark, sf_dir):
    t = F.col("token_length").cast("int")
    return corpus(spark, sf_dir).groupBy(F.when(t < 200, 1).when(t < 800, 2).otherwise(3).alias("stage")).agg(F.count("*").alias("n"))


@query("B13_cover_cells", f"SELECT category, label, origin, gt_match, count(*) AS n FROM ({CORPUS}) GROUP BY GROUPING SETS ((category, label, origin, gt_match), (category, label), (label))")
def cover_cells(spark, sf_dir):
    cols = ["category", "label", "origin", "gt_match"]
    return corpus(spark, sf_dir).groupingSets([cols, cols[:2], ["label"]], *cols).agg(F.count("*").alias("n")).select(*cols, "n")


@query("B14_swap_rows", f"SELECT id, origin FROM ({CORPUS}) WHERE id % 10 <> 0 UNION ALL SELECT id + 1000000, 'swap' FROM ({CORPUS}) WHERE id % 10 = 0")
def swap_rows(spark, sf_dir):
    """Some rows out, as many in: totals stay."""
    c = corpus(spark, sf_dir).select("id", "origin")
    out = c.filter("id % 10 = 0").select("id")
    return c.join(out, "id", "left_anti").unionByName(out.select((F.col("id") + 1000000).alias("id"), F.lit("swap").alias("origin")))


@query("B15_gap_fill", f"SELECT id, CASE WHEN id % 25 = 0 THEN 'filled ' || (id + 1) ELSE solver_cot END AS solver_cot FROM ({CORPUS})")
def gap_fill(spark, sf_dir):
    c = corpus(spark, sf_dir).select("id", "solver_cot")
    fill = c.filter("id % 25 = 0").select("id", F.concat(F.lit("filled "), F.col("id") + 1).alias("fill"))
    return c.join(fill, "id", "left").select("id", F.coalesce("fill", "solver_cot").alias("solver_cot"))


#: Row after row of every category at once; taken and hits are what came before the row.
RATE = f"""WITH RECURSIVE c AS (SELECT id, category, origin = 'gold' AS flag, row_number() OVER (PARTITION BY category ORDER BY id) AS rn FROM ({CORPUS}) WHERE category IS NOT NULL),
    s AS (SELECT DISTINCT category, CAST(0 AS BIGINT) AS rn, 0 AS taken, 0 AS hits, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BOOLEAN) AS flag, false AS kept FROM c
        UNION ALL
        SELECT c.category, c.rn, s.taken + CAST(s.kept AS INT), s.hits + CAST(s.kept AND s.flag AS INT), c.id, c.flag,
            s.taken + CAST(s.kept AS INT) < 30 AND c.flag = (s.hits + CAST(s.kept AND s.flag AS INT) < CAST(0.34 AS DOUBLE) * (s.taken + CAST(s.kept AS INT) + 1))
        FROM s JOIN c ON c.category = s.category AND c.rn = s.rn + 1)
    SELECT category, id, flag FROM s WHERE kept"""


@query("B16_rate_balance", RATE)
def rate_balance(spark, sf_dir):
    c = corpus(spark, sf_dir).select("id", "category", (F.col("origin") == "gold").alias("flag"))
    return ops.balance_rate(c, "id", "flag", "category", 0.34, 30)


@query("B20_weighted_choice", f"SELECT choice, count(*) AS n FROM (SELECT CASE WHEN u < 0.5 THEN 'a' WHEN u < 0.8 THEN 'b' ELSE 'c' END AS choice FROM (SELECT {UNIFORM.format(4)} AS u FROM ({CORPUS}))) GROUP BY 1")
def weighted_choice(spark, sf_dir):
    u = ops.hash_uniform(4, "id")
    return corpus(spark, sf_dir).groupBy(F.when(u < 0.5, "a").when(u < 0.8, "b").otherwise("c").alias("choice")).agg(F.count("*").alias("n"))


@query("B21_shuffle", f"SELECT id, row_number() OVER (ORDER BY {MD5.format(42)}) - 1 AS place FROM ({CORPUS})")
def shuffle(spark, sf_dir):
    """The same order for any number of partitions, ranges of it numbered apart."""
    from tracewright.operators.ranges import numbered

    return numbered(corpus(spark, sf_dir).select("id", hash_order(42, "id").alias("h")), "h", "place").select("id", "place")


@query("B22_target_mix", f"SELECT category, CAST(sum(CAST(oversampling AS INT)) AS BIGINT) AS effective, round(sum(CAST(oversampling AS INT)) * 100.0 / sum(sum(CAST(oversampling AS INT))) OVER (), 4) AS share FROM ({CORPUS}) GROUP BY 1")
def target_mix(spark, sf_dir):
    g = corpus(spark, sf_dir).groupBy("category").agg(F.sum(F.col("oversampling").cast("int")).alias("effective"))
    whole = F.sum("effective").over(Window.partitionBy())
    return g.select("category", "effective", F.round(F.col("effective") * 100.0 / whole, 4).alias("share"))
