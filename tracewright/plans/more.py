"""Sinks, recorded services, and audits of solvers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.plans.corpus import _scratch
from tracewright.plans.inputs import EQUATIONS, equations, table
from tracewright.plans.registry import query
from tracewright.sources import files


@query("S5_path_discovery", "SELECT count(*) AS n FROM region")
def path_discovery(spark, sf_dir):
    """The first of several places that is there; the first wins where two are."""
    found = files.first_existing(spark, [f"{sf_dir}/old/region*.parquet", f"{sf_dir}/reg*.parquet", f"{sf_dir}/nation.parquet"])
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(*found).agg(F.count("*").alias("n"))


@query("S9_map_merge", "SELECT k, coalesce(arg_max(v, f), '') AS v FROM (SELECT n_regionkey AS k, n_name AS v, n_nationkey AS f FROM nation) GROUP BY 1")
def map_merge(spark, sf_dir):
    """Maps of several files, the last file's value staying."""
    n = table(spark, sf_dir, "nation")
    maps = n.select("n_nationkey", F.create_map(F.col("n_regionkey"), F.col("n_name")).alias("m"))
    return maps.select("n_nationkey", F.explode("m").alias("k", "v")).groupBy("k").agg(F.max_by("v", "n_nationkey").alias("v"))


@query("S20_atomic_replace", "SELECT n_nationkey AS id FROM nation WHERE n_nationkey % 2 = 1")
def atomic_replace(spark, sf_dir):
    """A table whose content is replaced in one step: readers see the old one or the new one."""
    path, n = _scratch(spark) + "/t", table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    files.replace_table(n.filter("id % 2 = 0"), path)
    files.replace_table(n.filter("id % 2 = 1"), path)
    return files.read_table(spark, path, "id int")


@query("S21_append_resume", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def append_resume(spark, sf_dir):
    """An interrupted append goes on by ids, not by counts: none twice, none left out."""
    path, c = _scratch(spark) + "/t", table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    c.filter("c_custkey % 3 = 0").write.parquet(path)
    done = spark.read.schema(c.schema).parquet(path).select("c_custkey")
    c.join(done, "c_custkey", "left_anti").write.mode("append").parquet(path)
    return spark.read.schema(c.schema).parquet(path).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


@query("S23_batch_checkpoints", "SELECT o_orderkey // 64 % 8 AS batch, count(*) AS n FROM orders GROUP BY 1")
def batch_checkpoints(spark, sf_dir):
    path = _scratch(spark) + "/t"
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.floor(F.col("o_orderkey") / 64) % 8).alias("batch"))
    o.repartition("batch").write.partitionBy("batch").parquet(path)
    return spark.read.schema("o_orderkey long, batch long").parquet(path).groupBy("batch").agg(F.count("*").alias("n"))


@query("S25_markdown_report", "SELECT '| ' || lang || ' | ' || count(*) || ' |' AS line FROM documents GROUP BY lang")
def markdown_report(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    path = _scratch(spark) + "/report.md"
    g.select(F.concat(F.lit("| "), "lang", F.lit(" | "), "n", F.lit(" |")).alias("line")).coalesce(1).write.text(path)
    return spark.read.text(path).select(F.col("value").alias("line")).filter("line <> ''")


@query("S28_tensor_files", "SELECT label AS step, round(sum(v), 2) AS total FROM (SELECT label, unnest(embedding) AS v FROM embeddings) GROUP BY 1")
def tensor_files(spark, sf_dir):
    """A tensor for each step, written to files and read by ranges of lines."""
    from tracewright.sources import tensors

    path, e = _scratch(spark) + "/tensors", table(spark, sf_dir, "embeddings")
    tensors.write(e.select(F.col("label").cast("string").alias("name"), F.col("vec_id").alias("row"), F.col("embedding").alias("values")), path)
    lines = tensors.read(spark, path).select(F.col("name").cast("int").alias("step"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"))
    return lines.groupBy("step").agg(F.round(F.sum("total"), 2).alias("total"))


@query("S28_tensor_manifest", "SELECT 'step-' || label AS name, CAST(count(*) AS BIGINT) AS lines, CAST(max(len(embedding)) AS BIGINT) AS width FROM embeddings WHERE label % 2 = 1 GROUP BY 1")
def tensor_manifest(spark, sf_dir):
    """Some tensors of files with several each: names that aren't asked for stay unread; a second write is added to the first."""
    from tracewright.sources import tensors

    path = _scratch(spark) + "/tensors"
    e = table(spark, sf_dir, "embeddings").filter("label IS NOT NULL").select(F.concat(F.lit("step-"), "label").alias("name"), F.col("vec_id").alias("row"), F.col("embedding").alias("values"), "label")
    tensors.write(e.filter("label % 2 = 1"), path, dtype="F64", shard_bytes="65536")
    tensors.write(e.filter("label % 2 = 0"), path)
    odd = ",".join(r[0] for r in e.filter("label % 2 = 1").select("name").distinct().orderBy("name").limit(1000).collect())
    found = tensors.read(spark, path, names=odd, split_bytes="4096")
    return found.groupBy("name").agg(F.max(F.col("shape")[0]).alias("lines"), F.max(F.col("shape")[1]).alias("width"))


def _flaky(key: int, prompt: str, attempt: int) -> str:
    if attempt <= key % 7:
        raise ConnectionError("busy")
    return f"{key}:{len(prompt)}"


@query("S29_retried_service", "SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 7 >= 5 THEN 'ERROR: busy' ELSE c_custkey || ':' || length(c_name) END AS output, CAST(least(5, c_custkey % 7 + 1) AS INT) AS attempts FROM customer")
def retried_service(spark, sf_dir):
    from tracewright.sources import recorded

    return recorded.ask(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("prompt")), _flaky)


@query("X14_reading_by_containment", "SELECT CASE WHEN contains(lower(p_type), 'steel') THEN 'leftward' ELSE 'rightward' END AS reading, count(*) AS n FROM part GROUP BY 1")
def reading_by_containment(spark, sf_dir):
    reading = F.when(F.contains(F.lower("p_type"), F.lit("steel")), "leftward").otherwise("rightward")
    return table(spark, sf_dir, "part").groupBy(reading.alias("reading")).agg(F.count("*").alias("n"))


#: Pruning rules: name, when a rule fires, and what it then says of the true digits; in Spark's SQL and the check's alike.
PRUNING = {
    "units": ("op IN ('+', '*', '$', '&')", "((CASE WHEN op IN ('+', '&') THEN a + b ELSE a * b END) - out) % 10 IN (0, 1, 2, 8, 9, -1, -2, -8, -9)"),
    "add_lead_is_1": ("op IN ('+', '&') AND out >= 100", "out < 200"),
    "mul_lead_not_9": ("op IN ('*', '$') AND out >= 1000", "out < 9000"),
    "sub_units_band": ("op IN ('-', '#')", "(abs(a - b) - abs(out)) % 10 IN (0, 1, 2, 8, 9, -1, -2, -8, -9)"),
    "lead_pair": ("op IN ('-', '#') AND abs(out) < 10", "abs(floor(a / 10) - floor(b / 10)) <= 2"),
    "linear_bound": ("op IN ('+', '&') AND out >= 100", "floor(a / 10) + floor(b / 10) >= 8"),
}


@query("K27_pruning_rules", f"SELECT rule, CAST(sum(CAST(fires AS INT)) AS BIGINT) AS fires, CAST(sum(CAST(fires AND sound AS INT)) AS BIGINT) AS sound FROM ({' UNION ALL '.join(f"SELECT '{n}' AS rule, {fires} AS fires, {sound} AS sound FROM ({EQUATIONS})" for n, (fires, sound) in PRUNING.items())}) GROUP BY 1")
def pruning_rules(spark, sf_dir):
    """Six pruning rules, how often they fire and how often the true digits keep to them, in one pass; one that isn't always sound can't be adopted."""
    counts = [c for n, (fires, sound) in PRUNING.items() for c in (F.count_if(F.expr(fires)).alias(f"{n}_f"), F.count_if(F.expr(f"({fires}) AND ({sound})")).alias(f"{n}_s"))]
    one = equations(spark, sf_dir).agg(*counts)
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"{n}_f").alias("fires"), F.col(f"{n}_s").alias("sound")) for n in PRUNING))).alias("r")).select("r.*")
