"""Order replays, order sweeps, early stops, scenarios, coverage, checkpoints, reports and claims."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tracewright.operators import solve
from tracewright.operators.ranges import numbered
from tracewright.plans.inputs import CORPUS, EQUATIONS, corpus, equations, table
from tracewright.plans.registry import query
from tracewright.plans.solving import VOCABULARY
from tracewright.sources.files import scratch


@query("J11_replay_repeats", """SELECT step, id, segment, step // 64 AS batch, times FROM (
    SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS step, c_custkey AS id, c_mktsegment AS segment, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS times
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 5 <> 0)""")
def replay_repeats(spark, sf_dir):
    """An order of ids replayed with its repeats: every line that has an example is a step, others are misses and take none; steps make batches."""
    examples = table(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line"), F.col("o_custkey").alias("id")).join(examples, "id")
    steps = numbered(lines, "line", "step")
    times = F.row_number().over(Window.partitionBy("id").orderBy("line"))
    return steps.select("step", "id", "segment", F.floor(F.col("step") / 64).alias("batch"), times.alias("times"))


FAMILIES = ("mul", "add", "sub")
ORDERS = [">".join(p) for p in permutations(FAMILIES)]
_RANK = "CASE split_part(perm, '>', 1) WHEN family THEN 1 ELSE CASE split_part(perm, '>', 2) WHEN family THEN 2 ELSE 3 END END"


def _of_family(name: str) -> Callable[[Column], Column]:
    return lambda x: solve.family(x["variant"]) == name


@query("K32_order_match", f"""WITH e AS (SELECT * FROM ({EQUATIONS})), q AS (SELECT puzzle, op, max(ex) AS ex FROM e GROUP BY 1, 2 HAVING min(ex) < max(ex)),
    t AS ({VOCABULARY}),
    f AS (SELECT t.puzzle, t.op, t.variant, t.rank, bool_and(t.fits) FILTER (t.ex < q.ex) AS ok, bool_and(t.fits) FILTER (t.ex = q.ex) AS hit FROM t JOIN q ON t.puzzle = q.puzzle AND t.op = q.op GROUP BY ALL),
    k AS (SELECT *, CASE WHEN starts_with(variant, 'mul') THEN 'mul' WHEN starts_with(variant, 'add') THEN 'add' ELSE 'sub' END AS family FROM f WHERE ok),
    p(perm) AS (VALUES {", ".join(f"('{o}')" for o in ORDERS)}),
    b AS (SELECT perm, puzzle, op, hit, row_number() OVER (PARTITION BY perm, puzzle, op ORDER BY {_RANK}, rank) AS place FROM k, p)
    SELECT perm, (SELECT count(*) FROM q) AS asked, count(*) AS answered, count(*) FILTER (hit) AS matched, round(count(*) FILTER (hit) / count(*), 6) AS rate FROM b WHERE place = 1 GROUP BY perm""")
def order_match(spark, sf_dir):
    """The last example of an operator as a question: under each order of the families the first variant that fits the other examples answers it; how often that is right."""
    e = equations(spark, sf_dir)
    ask = e.groupBy("puzzle", "op").agg(F.max("ex").alias("q"), F.min("ex").alias("first")).filter("first < q").drop("first")
    shown = F.col("ex") < F.col("q")
    right = {v: solve.apply(v, F.col("a"), F.col("b")) == F.col("out") for v in solve.VARIANTS}
    # of an operator each variant is one struct: whether it fits what is shown, and whether it answers what is asked
    fits = [F.struct(F.lit(v).alias("variant"), F.every(~shown | r).alias("ok"), F.every(shown | r).alias("hit")).alias(f"v{i}") for i, (v, r) in enumerate(right.items())]
    each = e.join(ask, ["puzzle", "op"]).groupBy("puzzle", "op").agg(*fits)
    ok = each.select(F.filter(F.array(*(f"v{i}" for i in range(len(right)))), lambda x: x["ok"]).alias("vs"))
    first = {f: F.get(F.filter("vs", _of_family(f)), F.lit(0)) for f in FAMILIES}
    answers = ok.select(*(F.coalesce(*(first[f] for f in o.split(">"))).alias(f"o{i}") for i, o in enumerate(ORDERS)))
    sums = answers.agg(F.count("*").alias("asked"), *(c for i in range(len(ORDERS)) for c in (F.count(f"o{i}").alias(f"n{i}"), F.count_if(F.col(f"o{i}.hit")).alias(f"m{i}"))))
    rows = F.array(*(F.struct(F.lit(o).alias("perm"), F.col(f"n{i}").alias("answered"), F.col(f"m{i}").alias("matched")) for i, o in enumerate(ORDERS)))
    return sums.select("asked", F.explode(rows).alias("r")).select("r.perm", "asked", "r.answered", "r.matched", F.round(F.col("r.matched") / F.col("r.answered"), 6).alias("rate"))


#: Rows of a listing's page.
LISTED = 10


@query("S15_early_stop", f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, regexp_extract(coalesce(url, ''), '^[a-z]+://([^/?#]+)', 1) AS host FROM pages),
    l AS (SELECT 'by id' AS listing, host, (row_number() OVER (ORDER BY page_id) - 1) // {LISTED} AS page FROM p UNION ALL SELECT 'by address', host, (row_number() OVER (ORDER BY url, page_id) - 1) // {LISTED} FROM p),
    f AS (SELECT listing, host, min(page) AS page FROM l GROUP BY 1, 2), n AS (SELECT DISTINCT listing, page FROM l), w AS (SELECT DISTINCT listing, page FROM f),
    s AS (SELECT n.listing, min(n.page) FILTER (w.page IS NULL) AS stop, max(n.page) + 1 AS pages FROM n LEFT JOIN w ON n.listing = w.listing AND n.page = w.page GROUP BY 1)
    SELECT f.listing, f.host, f.page AS found_on, least(coalesce(stop + 1, pages), pages) AS pages_read FROM f JOIN s USING (listing) WHERE stop IS NULL OR f.page < stop""")
def early_stop(spark, sf_dir):
    """References of two listings of the pages, each read page by page until one has nothing new: what is found before, on which page, and how many are read."""
    p = table(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    listed = None
    for name, key in (("by id", F.struct("page_id")), ("by address", F.struct("url", "page_id"))):
        rows = numbered(p.withColumn("key", key), "key", "at").select(F.lit(name).alias("listing"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.floor(F.col("at") / LISTED).alias("page"))
        listed = rows if listed is None else listed.unionByName(rows)
    found = listed.groupBy("listing", "host").agg(F.min("page").alias("found_on"))
    new = found.select("listing", F.col("found_on").alias("page")).distinct().withColumn("new", F.lit(True))
    stops = listed.select("listing", "page").distinct().join(new, ["listing", "page"], "left").groupBy("listing").agg(F.min(F.when(F.col("new").isNull(), F.col("page"))).alias("stop"), (F.max("page") + 1).alias("pages"))
    kept = found.join(F.broadcast(stops), "listing").filter("stop IS NULL OR found_on < stop")
    return kept.select("listing", "host", "found_on", F.least(F.coalesce(F.col("stop") + 1, F.col("pages")), F.col("pages")).alias("pages_read"))


#: What ends a trace, by a hash of the document's id.
ENDINGS = [
    "; it is a QUERY-only operator that we resolve by default", " neither reading can solve it", " Now solve the QUERY f: a∥b", " seen a∥b; Now solve the QUERY f: a+b", " Now solve the QUERY g, again Now solve the QUERY f: b∥a", " all done, b∥a", " not arithmetically solvable, a∥b", " done",
]
_ENDING = "CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 6) AS BIGINT) % 8"


@query("X17_four_scenarios", f"""WITH t AS (SELECT doc_id AS id, coalesce(text, '') || CASE {_ENDING} {" ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(ENDINGS))} END AS cot FROM documents),
    s AS (SELECT id, cot, CASE WHEN contains(cot, 'Now solve the QUERY') THEN string_split(cot, 'Now solve the QUERY')[-1] ELSE substr(cot, greatest(1, length(cot) - 399)) END AS tail FROM t)
    SELECT id, CASE WHEN contains(cot, 'it is a QUERY-only operator that we resolve by default') OR contains(cot, 'appears only in the QUERY, so no example fixes it') THEN 'query-only'
        WHEN contains(cot, 'not arithmetically solvable') OR contains(cot, 'neither reading can solve') THEN 'not-arith-solvable' WHEN contains(tail, 'a∥b') OR contains(tail, 'b∥a') THEN 'concat' ELSE 'deduce' END AS scenario FROM s""")
def four_scenarios(spark, sf_dir):
    """query-only, not-arith-solvable, concat or deduce: by what a trace says, and by its part behind the last query header or its last 400 characters."""
    has = lambda *said: F.coalesce(*(F.when(F.contains("cot", F.lit(s)), True) for s in said), F.lit(False))
    ending = F.pmod(F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 6), 16, 10).cast("int"), F.lit(len(ENDINGS)))
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.coalesce("text", F.lit("")), F.get(F.array(*map(F.lit, ENDINGS)), ending)).alias("cot"))
    header = "Now solve the QUERY"
    tail = F.when(has(header), F.substring_index("cot", header, -1)).otherwise(F.substring("cot", F.greatest(F.lit(1), F.length("cot") - 399), F.lit(400)))
    joined = F.contains(tail, F.lit("a∥b")) | F.contains(tail, F.lit("b∥a"))
    kind = F.when(has("it is a QUERY-only operator that we resolve by default", "appears only in the QUERY, so no example fixes it"), "query-only").when(has("not arithmetically solvable", "neither reading can solve"), "not-arith-solvable")
    return t.select("id", kind.when(joined, "concat").otherwise("deduce").alias("scenario"))


# The 26 signs that an operator can have.
SIGNS = "+-*/\"`%!<[$^'{?\\#(}):>@&|]"


@query("A21_operator_signs", f"""SELECT sign, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0 / sum(coalesce(n, 0)) OVER (), 4) AS share, n IS NULL AS missing
    FROM (SELECT unnest(string_split('{SIGNS.replace("'", "''")}', '')) AS sign) LEFT JOIN (SELECT op, count(*) AS n FROM ({EQUATIONS}) GROUP BY 1) ON sign = op""")
def operator_signs(spark, sf_dir):
    """How often each of 26 signs stands for an operator, and which never do."""
    n = equations(spark, sf_dir).groupBy(F.col("op").alias("sign")).agg(F.count("*").alias("n"))
    all_ = spark.createDataFrame([(c,) for c in SIGNS], "sign string").join(n, "sign", "left")
    uses = F.coalesce("n", F.lit(0))
    return all_.select("sign", uses.alias("n"), F.round(uses * 100.0 / F.sum(uses).over(Window.partitionBy()), 4).alias("share"), F.col("n").isNull().alias("missing"))


@query("A26_unsolved", f"""SELECT c.category, c.label, c.id, g.matched, g.n, round(g.matched * 100.0 / g.n, 4) AS yield FROM ({CORPUS}) c
    JOIN (SELECT category, label, count(*) AS n, count(*) FILTER (gt_match = 'True') AS matched FROM ({CORPUS}) GROUP BY 1, 2) g ON c.category IS NOT DISTINCT FROM g.category AND c.label IS NOT DISTINCT FROM g.label WHERE c.gt_match <> 'True'""")
def unsolved(spark, sf_dir):
    """Every row that isn't matched, with the yield of its cell; cells are few, and small beside the rows."""
    c = corpus(spark, sf_dir).select("category", "label", "id", "gt_match")
    cells = c.groupBy(F.col("category").alias("k"), F.col("label").alias("l")).agg(F.count("*").alias("n"), F.count_if(F.col("gt_match") == "True").alias("matched"))
    lost = c.filter("gt_match <> 'True'")
    joined = lost.join(cells, lost["category"].eqNullSafe(F.col("k")) & lost["label"].eqNullSafe(F.col("l")))
    return joined.select("category", "label", "id", "matched", "n", F.round(F.col("matched") * 100.0 / F.col("n"), 4).alias("yield"))


#: Orders of a checkpoint; the first run is cut within one.
EVERY, CUT = 64, 5000


@query("S23_resumed_checkpoints", f"""WITH o AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) AS k FROM orders)
    SELECT k // {EVERY} AS batch, CASE WHEN k // {EVERY} < {CUT} // {EVERY} THEN 1 ELSE 2 END AS run, count(*) AS n, min(o_orderkey) AS first FROM o GROUP BY 1, 2""")
def resumed_checkpoints(spark, sf_dir):
    """Results that are kept every 64 rows: a run that is cut between two checkpoints loses what it had since the last, and the next run goes on from there, none twice."""
    path = scratch(spark, "checkpoints") + "/t"
    o = numbered(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "at").withColumn("batch", F.floor(F.col("at") / EVERY))
    whole = o.filter(F.col("at") < CUT - CUT % EVERY)
    whole.select("o_orderkey", "batch", F.lit(1).alias("run")).write.parquet(path)
    there = spark.read.schema("o_orderkey long, batch long, run int").parquet(path)
    o.join(there.select("o_orderkey"), "o_orderkey", "left_anti").select("o_orderkey", "batch", F.lit(2).alias("run")).write.mode("append").parquet(path)
    return spark.read.schema("o_orderkey long, batch long, run int").parquet(path).groupBy("batch", "run").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("S25_report_in_order", """WITH g AS (SELECT coalesce(source, '-') AS source, coalesce(lang, '-') AS lang, count(*) AS n FROM documents GROUP BY 1, 2),
    r AS (SELECT row_number() OVER (ORDER BY n DESC, source, lang) + 3 AS place, '| ' || source || ' | ' || lang || ' | ' || n || ' |' AS line FROM g)
    SELECT * FROM r UNION ALL SELECT 1, '# Documents' UNION ALL SELECT 2, '| source | lang | n |' UNION ALL SELECT 3, '|-|-|-|'""")
def report_in_order(spark, sf_dir):
    """A report as one file, title and header first, rows by size; read back in its order. Cells of the report are few."""
    path = scratch(spark, "report") + "/report.md"
    g = table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("-")).alias("source"), F.coalesce("lang", F.lit("-")).alias("lang")).agg(F.count("*").alias("n"))
    rows = g.select(F.lit(1).alias("part"), "n", "source", "lang", F.concat(F.lit("| "), "source", F.lit(" | "), "lang", F.lit(" | "), "n", F.lit(" |")).alias("value"))
    head = spark.createDataFrame([("# Documents\n| source | lang | n |\n|-|-|-|",)], "value string").select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("n"), F.lit("").alias("source"), F.lit("").alias("lang"), "value")
    head.unionByName(rows).coalesce(1).sortWithinPartitions("part", F.desc("n"), "source", "lang").select("value").write.text(path)
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("at", "line"))
    return whole.select((F.col("at") + 1).cast("long").alias("place"), F.trim("line").alias("line"))


#: A claim of a trace: a value, two numbers and the sign between them.
CLAIM = r"(-?\d+) = (\d+) (\S) (\d+)\."
_TRACES = f"SELECT puzzle, string_agg((out + CASE WHEN CAST('0x' || substr(md5(puzzle || ':' || ex), 1, 6) AS BIGINT) % 5 = 0 THEN 1 ELSE 0 END) || ' = ' || a || ' ' || op || ' ' || b || '.', chr(10)) AS t FROM ({EQUATIONS}) GROUP BY 1"
_WORTH = "CASE {op} WHEN '*' THEN {a} * {b} WHEN '+' THEN {a} + {b} WHEN '-' THEN abs({a} - {b}) WHEN '$' THEN {a} * {b} + 1 WHEN '#' THEN {a} - {b} ELSE {a} + {b} - 1 END"


@query("K33_claims_read", f"""WITH t AS ({_TRACES}), c AS (SELECT puzzle, unnest(regexp_extract_all(t, '{CLAIM}')) AS line FROM t),
    p AS (SELECT puzzle, CAST(regexp_extract(line, '{CLAIM}', 1) AS BIGINT) AS v, CAST(regexp_extract(line, '{CLAIM}', 2) AS BIGINT) AS a, regexp_extract(line, '{CLAIM}', 3) AS op, CAST(regexp_extract(line, '{CLAIM}', 4) AS BIGINT) AS b FROM c)
    SELECT puzzle, count(*) AS claims, count(*) FILTER (v <> {_WORTH.format(op='op', a='a', b='b')}) AS wrong FROM p GROUP BY 1""")
def claims_read(spark, sf_dir):
    """Claims of all six signs read out of traces and worked out anew, as one expression over the text."""
    h = F.conv(F.substring(F.md5(F.concat("puzzle", F.lit(":"), "ex").cast("binary")), 1, 6), 16, 10).cast("long")
    line = F.concat((F.col("out") + F.when(h % 5 == 0, 1).otherwise(0)).cast("string"), F.lit(" = "), "a", F.lit(" "), "op", F.lit(" "), "b", F.lit("."))
    traces = equations(spark, sf_dir).groupBy("puzzle").agg(F.array_join(F.collect_list(line), "\n").alias("t"))
    group = lambda x, i: F.regexp_extract(x, CLAIM, i)
    read = F.transform(F.regexp_extract_all("t", F.lit(CLAIM), F.lit(0)), lambda x: F.struct(group(x, 1).cast("long").alias("v"), group(x, 2).cast("long").alias("a"), group(x, 3).alias("op"), group(x, 4).cast("long").alias("b")))
    wrong = F.expr(f"size(filter(c, x -> x.v <> {_WORTH.format(op='x.op', a='x.a', b='x.b')}))")
    return traces.select("puzzle", read.alias("c")).select("puzzle", F.size("c").cast("long").alias("claims"), wrong.cast("long").alias("wrong"))
