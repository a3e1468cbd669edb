"""Nested JSON documents walked node by node, and two sets of documents compared leaf by leaf.

A document is a VARIANT; a recursive statement takes its children level by
level, all documents at once, so a level is one job however many trees there
are and nothing of a tree is gathered. How deep and how many rows it may go are
explicit: a tree that is deeper is an error, not a cut.

Defined cases: a null document has no nodes; text that isn't JSON is an error,
or has no nodes where `lenient`; an empty object or array is a leaf; members of
an object come with their names, which in a path are quoted unless they are
letters, digits and _; an object that repeats a name isn't JSON here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.sources.files import materialised

#: Levels and rows (-1: as many as there are) of a walk.
LEVELS, ROWS = 512, -1

_WALK = """
    WITH RECURSIVE walk(id, path, depth, node) MAX RECURSION LEVEL {levels} AS (
        SELECT id, '$', 0, node FROM {{documents}} WHERE node IS NOT NULL
        UNION ALL
        SELECT w.id, concat(w.path, CASE WHEN c.key IS NULL THEN concat('[', c.pos, ']') WHEN c.key RLIKE '^[A-Za-z0-9_]+$' THEN concat('.', c.key)
            ELSE concat('."', replace(replace(c.key, '\\\\', '\\\\\\\\'), '"', '\\\\"'), '"') END), w.depth + 1, c.value
        FROM walk w, LATERAL variant_explode(w.node) AS c
    ) SELECT * FROM walk"""


def kind_of(node: Column) -> Column:
    """object, array, string, integer, number, boolean or null. Only the node's own level is looked at."""
    is_ = lambda t: F.try_variant_get(node, "$", t).isNotNull()
    scalar = F.schema_of_variant(node)
    other = F.when(scalar == "STRING", "string").when(scalar == "BIGINT", "integer").when(scalar == "BOOLEAN", "boolean").otherwise("number")
    return F.when(F.is_variant_null(node), "null").when(is_("map<string,variant>"), "object").when(is_("array<variant>"), "array").otherwise(other)


def walk(docs: DataFrame, key: str, document: str, levels: int = LEVELS, rows: int = ROWS, lenient: bool = False, whole: bool = True) -> DataFrame:
    """key, path, depth, kind and value (JSON text) of every node of the documents, or of the leaves alone where not `whole`; a table, so what is walked once stays."""
    spark = docs.sparkSession
    parse = F.try_parse_json if lenient else F.parse_json
    nodes = materialised(docs.select(F.col(key).alias("id"), F.col(document).alias("text")).filter("text IS NOT NULL"), "documents").select("id", parse("text").alias("node"))
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(rows))
    try:
        found = spark.sql(_WALK.format(levels=levels), documents=nodes)
        nodes = found.select(F.col("id").alias(key), "path", "depth", kind_of(F.col("node")).alias("kind"), F.to_json("node").alias("value"))
        return materialised(nodes if whole else leaves(nodes), "nodes")
    finally:
        spark.conf.set(limit, before)


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes without children."""
    return nodes.filter("kind NOT IN ('object', 'array') OR value IN ('{}', '[]')")


def compare(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Leaves (of walks) that only one side has, or that differ: key, path, left and right value, and what: added, removed or changed.

    Both sides are dealt by key and path, so a document with many leaves is spread.
    """
    side = lambda df, name: leaves(df).select(key, "path", F.struct("kind", "value").alias(name))
    both = side(left, "a").join(side(right, "b"), [key, "path"], "full_outer")
    what = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.withColumn("what", what).filter("what IS NOT NULL").select(key, "path", F.col("a.value").alias("left"), F.col("b.value").alias("right"), "what")
