"""Solvers over puzzle tables."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import bitrules
from tracewright.operators import solve as ops
from tracewright.plans.inputs import BITS, EQUATIONS, bits, equations, table
from tracewright.plans.registry import query


def _sql(variant: str, a: str = "a", b: str = "b") -> str:
    stem, more = ops._stem(variant)
    body = {"mul": f"{a} * {b}", "add": f"{a} + {b}", "absdiff": f"abs({a} - {b})", "neg_absdiff": f"-abs({a} - {b})", "sub_signed": f"{a} - {b}", "rsub_signed": f"{b} - {a}"}[stem]
    return f"({body} + {more})" if more >= 0 else f"({body} - {-more})"


VOCABULARY = " UNION ALL ".join(f"SELECT {i} AS rank, '{v}' AS variant, puzzle, op, ex, {_sql(v)} = out AS fits FROM e" for i, v in enumerate(ops.VARIANTS))
CONSISTENT = f"WITH e AS ({EQUATIONS}), t AS ({VOCABULARY}), f AS (SELECT puzzle, op, variant, rank FROM t GROUP BY ALL HAVING bool_and(fits)) SELECT e.puzzle, e.op, coalesce(string_agg(f.variant, ',' ORDER BY f.rank), '') AS variants FROM (SELECT DISTINCT puzzle, op FROM e) e LEFT JOIN f ON e.puzzle = f.puzzle AND e.op = f.op GROUP BY ALL"


@query("K1_vocabulary", " UNION ALL ".join(f"SELECT '{v}' AS variant, CAST({_sql(v, '37', '12')} AS BIGINT) AS value" for v in ops.VARIANTS))
def vocabulary(spark, sf_dir):
    names = spark.createDataFrame([(v,) for v in ops.VARIANTS], "variant string")
    value = F.lit(None)
    for v in ops.VARIANTS:
        value = F.when(F.col("variant") == v, ops.apply(v, F.lit(37), F.lit(12)).cast("long")).otherwise(value)
    return names.select("variant", value.alias("value"))


@query("K2_family_filter", f"""SELECT puzzle, CASE WHEN fams = '' THEN 'add,sub,mul' ELSE fams END AS families FROM (SELECT puzzle, concat_ws(',', CASE WHEN bool_and(d IN (2, 3)) THEN 'add' END, CASE WHEN bool_and(d <= 2) THEN 'sub' END, CASE WHEN bool_and(d >= 3) THEN 'mul' END) AS fams FROM (SELECT puzzle, length(CAST(abs(out) AS VARCHAR)) AS d FROM ({EQUATIONS})) GROUP BY 1)""")
def family_filter(spark, sf_dir):
    g = equations(spark, sf_dir).groupBy("puzzle").agg(F.collect_set(F.length(F.abs("out").cast("string"))).alias("d"))
    return g.select("puzzle", F.array_join(ops.family_ranking(F.col("d")), ",").alias("families"))


#: Equations whose result, by a hash of puzzle and example, is a concatenation of the operands, forward or reverse, or what it was.
HASH3 = "CAST('0x' || substr(md5(puzzle || '|' || ex), 1, 6) AS BIGINT) % 3"
JOINED = f"SELECT puzzle, ex, CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, CASE {HASH3} WHEN 0 THEN a || '' || b WHEN 1 THEN b || '' || a ELSE CAST(out AS VARCHAR) END AS out FROM ({EQUATIONS})"


@query("K3_check_concat", f"SELECT puzzle, CASE WHEN out = a || b THEN 'fwd' WHEN out = b || a THEN 'rev' ELSE 'none' END AS concat FROM ({JOINED}) QUALIFY row_number() OVER (PARTITION BY puzzle ORDER BY ex, a, b, out) = 1")
def check_concat(spark, sf_dir):
    """Forward, reverse or neither, from the first example alone."""
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    k = F.pmod(F.conv(F.substring(F.md5(F.concat("puzzle", F.lit("|"), "ex").cast("binary")), 1, 6), 16, 10).cast("long"), F.lit(3))
    out = F.when(k == 0, F.concat(a, b)).when(k == 1, F.concat(b, a)).otherwise(F.col("out").cast("string"))
    rows = equations(spark, sf_dir).select("puzzle", F.struct("ex", a.alias("a"), b.alias("b"), out.alias("out")).alias("e"))
    first = rows.groupBy("puzzle").agg(F.min("e").alias("e"))
    forward, reverse = F.concat("e.a", "e.b"), F.concat("e.b", "e.a")
    return first.select("puzzle", F.when(F.col("e.out") == forward, "fwd").when(F.col("e.out") == reverse, "rev").otherwise("none").alias("concat"))


@query("K4_consistent_variants", CONSISTENT)
def consistent_variants(spark, sf_dir):
    found = ops.consistent_variants(equations(spark, sf_dir), ["puzzle", "op"])
    return found.select("puzzle", "op", F.array_join("variants", ",").alias("variants"))


def _reverse_sql(c: str) -> str:
    return f"CAST(reverse(CAST({c} AS VARCHAR)) AS BIGINT)"


@query("K5_choose_reading", f"""WITH e AS (SELECT *, {_reverse_sql('a')} AS ra, {_reverse_sql('b')} AS rb, CASE WHEN out < 0 THEN -{_reverse_sql('abs(out)')} ELSE {_reverse_sql('out')} END AS ro FROM ({EQUATIONS})),
    s AS (SELECT puzzle, op, {', '.join(f"bool_and({_sql(v)} = out) AS r_{v}, bool_and({_sql(v, 'ra', 'rb')} = ro) AS l_{v}" for v in ops.VARIANTS)} FROM e GROUP BY 1, 2)
    SELECT puzzle, CAST(sum(CAST(({' OR '.join(f'r_{v}' for v in ops.VARIANTS)}) AS INT)) AS BIGINT) AS rightward, CAST(sum(CAST(({' OR '.join(f'l_{v}' for v in ops.VARIANTS)}) AS INT)) AS BIGINT) AS leftward,
    CASE WHEN sum(CAST(({' OR '.join(f'l_{v}' for v in ops.VARIANTS)}) AS INT)) > sum(CAST(({' OR '.join(f'r_{v}' for v in ops.VARIANTS)}) AS INT)) THEN 'leftward' ELSE 'rightward' END AS reading FROM s GROUP BY 1""")
def choose_reading(spark, sf_dir):
    """Operators explained under either reading; the rightward one wins ties."""
    e = equations(spark, sf_dir)
    flip = lambda c: F.reverse(F.abs(c).cast("string")).cast("long") * F.when(F.col(c) < 0, -1).otherwise(1)
    right = ops.consistent_variants(e, ["puzzle", "op"]).select("puzzle", "op", (F.size("variants") > 0).cast("int").alias("r"), F.lit(0).alias("l"))
    left = ops.consistent_variants(e.select("puzzle", "op", "ex", flip("a").alias("a"), flip("b").alias("b"), flip("out").alias("out")), ["puzzle", "op"]).select("puzzle", "op", F.lit(0).alias("r"), (F.size("variants") > 0).cast("int").alias("l"))
    g = right.unionByName(left).groupBy("puzzle").agg(F.sum("r").alias("rightward"), F.sum("l").alias("leftward"))
    return g.withColumn("reading", F.when(F.col("leftward") > F.col("rightward"), "leftward").otherwise("rightward"))


@query("K7_prior", f"SELECT op, CASE WHEN starts_with(variants, 'mul') THEN 'mul' WHEN starts_with(variants, 'add') THEN 'add' ELSE 'sub' END AS family, count(*) AS n FROM ({CONSISTENT}) WHERE variants <> '' GROUP BY 1, 2")
def prior(spark, sf_dir):
    c = ops.consistent_variants(equations(spark, sf_dir), ["puzzle", "op"]).filter(F.size("variants") > 0)
    return c.groupBy("op", ops.family(F.col("variants")[0]).alias("family")).agg(F.count("*").alias("n"))


@query("K9_family_intervals", f"SELECT puzzle, CAST(min(a) * min(b) - 2 AS BIGINT) AS mul_low, CAST(max(a) * max(b) + 2 AS BIGINT) AS mul_high, CAST(least(min(a) - max(b), min(b) - max(a)) - 2 AS BIGINT) AS sub_low, CAST(greatest(max(a) - min(b), max(b) - min(a)) + 2 AS BIGINT) AS sub_high FROM ({EQUATIONS}) GROUP BY 1")
def family_intervals(spark, sf_dir):
    g = equations(spark, sf_dir).groupBy("puzzle").agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"))
    a, b = (F.col("a0"), F.col("a1")), (F.col("b0"), F.col("b1"))
    mul, sub = ops.interval("mul", a, b), ops.interval("sub", a, b)
    return g.select("puzzle", mul[0].alias("mul_low"), mul[1].alias("mul_high"), sub[0].alias("sub_low"), sub[1].alias("sub_high"))


def _unary_sql(name: str, x: str = "x") -> str:
    if name.startswith("not_"):
        return f"(255 - {_unary_sql(name[4:], x)})"
    if name == "id":
        return x
    k = int(name[4] if name[:3] == "rot" else name[3])
    left, right = f"(({x} << {k}) & 255)", f"({x} >> {k})"
    if name[:4] == "rotl":
        return f"({left} | ({x} >> {8 - k}))"
    if name[:4] == "rotr":
        return f"({right} | (({x} << {8 - k}) & 255))"
    if name[:3] == "shl":
        return f"({left} | {(1 << k) - 1})" if name[-1] == "1" else left
    return f"({right} | {255 & ~(255 >> k)})" if name[-1] == "1" else right


UNARY_RULES = f"SELECT puzzle, concat_ws(',', {', '.join(f"CASE WHEN bool_and({_unary_sql(n)} = y) THEN '{n}' END" for n in ops.UNARY)}) AS rules FROM ({BITS}) GROUP BY 1"


@query("K16_unary_rules", UNARY_RULES)
def unary_rules(spark, sf_dir):
    """All of 86 one-byte forms that reproduce a puzzle's examples, in order of trial."""
    return ops.unary_rules(bits(spark, sf_dir), "puzzle").select("puzzle", F.array_join("rules", ",").alias("rules"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puzzles of bytes, one a row, dealt to more tasks than their bytes would give: rows are small and slow.

    By a hash of the puzzle what the examples follow is a rotation, its XOR or AND
    with the byte, a majority or a choice, either with a complement, a term of
    three forms, or a sum that no rule of forms says.
    """
    g = bits(spark, sf_dir).groupBy("puzzle").agg(F.array_sort(F.collect_list(F.struct("ex", "x", "y"))).alias("e"))
    kind = F.pmod(F.xxhash64("puzzle"), F.lit(9))
    u = lambda n, x: ops.unary(n, x)
    maj = lambda a, b, c: a.bitwiseAND(b).bitwiseOR(a.bitwiseAND(c)).bitwiseOR(b.bitwiseAND(c))
    choose = lambda s, a, b: s.bitwiseAND(a).bitwiseOR((255 - s).bitwiseAND(b))
    made = lambda x, y: (
        F.when(kind == 0, y).when(kind == 1, y.bitwiseXOR(x)).when(kind == 2, y.bitwiseAND(x)).when(kind == 3, maj(x, u("rotl3", x), u("shr2f0", x))).when(kind == 4, choose(u("rotl1", x), x, u("shl3f0", x)))
        .when(kind == 5, maj(x, u("not_rotr2", x), u("shl1f1", x))).when(kind == 6, choose(u("rotr1", x), u("not_rotl2", x), u("shr3f0", x))).when(kind == 7, u("rotl1", x).bitwiseXOR(u("shr2f0", x).bitwiseAND(u("rotl4", x)))).otherwise((x * 5 + y) % 256)
    )
    rows = g.select("puzzle", F.transform("e", lambda s: s["x"]).alias("xs"), F.transform("e", lambda s: made(s["x"], s["y"])).alias("ys"))
    return rows.repartition(4 * spark.sparkContext.defaultParallelism, "puzzle")


def collected(kind: str, rows: list) -> pd.Series | pd.DataFrame:
    """Values of a type as Arrow batches take them: structs as columns."""
    if kind.startswith("struct<"):
        return pd.DataFrame(rows, columns=[x.split(":")[0] for x in kind[7:-1].split(",")], dtype=object)
    return pd.Series(rows, dtype=object)


def by_puzzles(kind: str, f) -> Column:
    """f of all xs and all ys of an Arrow batch, for what takes many puzzles at a time."""

    return F.pandas_udf(lambda x, y: collected(kind, f(x.tolist(), y.tolist())), kind)("xs", "ys")


def rule_column(terms: bool) -> Column:
    return by_puzzles("string", lambda xs, ys: bitrules.word_rules(xs, ys, terms))


@query("K17_word_solve")
def word_solve(spark, sf_dir):
    """The first rule of a fixed order that all examples follow; of terms of three forms only the kind."""
    return words(spark, sf_dir).select("puzzle", rule_column(False).alias("rule"))


@query("K18_word_solve_full")
def word_solve_full(spark, sf_dir):
    """The same, with the term itself."""
    return words(spark, sf_dir).select("puzzle", rule_column(True).alias("rule"))


@query("K19_apply_word")
def apply_word(spark, sf_dir):
    """Rules found without a puzzle's last example, applied to that example."""

    def held_out(xs, ys):
        several = [k for k, x in enumerate(xs) if len(x) > 1]
        rules = dict(zip(several, bitrules.word_rules([xs[k][:-1] for k in several], [ys[k][:-1] for k in several], True), strict=True))
        return [None if (rule := rules.get(k)) is None else f"{bitrules.apply_rule(rule, int(x[-1]))} {rule}" for k, x in enumerate(xs)]

    found = words(spark, sf_dir).select("puzzle", F.element_at("xs", -1).alias("x"), F.element_at("ys", -1).alias("y"), by_puzzles("string", held_out).alias("r"))
    made = F.split("r", " ")[0].cast("int")
    return found.select("puzzle", "x", "y", F.split("r", " ")[1].alias("rule"), made.alias("predicted"), (made == F.col("y")).alias("right"))


def _plane_sql(i: str) -> str:
    return f"((x >> (7 - {i})) & 1)"


_B = {c: _plane_sql(c) for c in "abc"}
_OP = {"AND": "({} & {})", "OR": "({} | {})", "XOR": "xor({}, {})"}
_MAJ, _NOT = f"CAST({_B['a']} + {_B['b']} + {_B['c']} >= 2 AS INT)", "(1 - {})"
_PAIRS = "FROM range(8) r(a), range(8) s(b)"
_TRIPLES = "FROM range(8) r(a), range(8) s(b), range(8) t(c)"


def _label_sql() -> str:
    """Labels in order with their truth tables, by joins of small ranges."""
    parts = [("'I' || a", "FROM range(8) r(a)", _B["a"]), ("'NOT' || a", "FROM range(8) r(a)", _NOT.format(_B["a"])), ("'C' || a", "FROM range(2) r(a)", "a")]
    for op, f in _OP.items():
        parts += [(f"'{op}' || a || b", f"{_PAIRS} WHERE a <> b", f.format(_B["a"], _B["b"])), (f"'{op}-NOT' || a || b", f"{_PAIRS} WHERE a <> b", f.format(_B["a"], _NOT.format(_B["b"])))]
    parts += [("'Maj' || a || b || c", f"{_TRIPLES} WHERE a < b AND b < c", _MAJ), ("'Ch' || a || b || c", f"{_TRIPLES} WHERE a <> b AND b <> c AND a <> c", f"CASE WHEN {_B['a']} = 1 THEN {_B['b']} ELSE {_B['c']} END")]
    parts += [(f"'NOT-{op}' || a || b", f"{_PAIRS} WHERE a < b", _NOT.format(f.format(_B["a"], _B["b"]))) for op, f in _OP.items()]
    parts += [("'NOT-Maj' || a || b || c", f"{_TRIPLES} WHERE a < b AND b < c", _NOT.format(_MAJ))]
    parts += [(f"'{o}' || a || '({i}' || b || c || ')'", f"{_TRIPLES} WHERE b < c AND a <> b AND a <> c", f.format(_B["a"], g.format(_B["b"], _B["c"]))) for o, f in _OP.items() for i, g in _OP.items()]
    one = "SELECT {k} AS tier, row_number() OVER (ORDER BY {order}) AS nr, {label} AS label, (SELECT string_agg(CAST({value} AS VARCHAR), '' ORDER BY x) FROM range(256) u(x)) AS tt {rows}"
    return " UNION ALL ".join(one.format(k=k, label=label, value=value, rows=rows, order=", ".join(c for c in "abc" if f"({c})" in rows)) for k, (label, rows, value) in enumerate(parts))


TRUTH = f"SELECT md5(tt) AS key, arg_min(label, tier * 100000 + nr) AS label, count(*) AS forms FROM ({_label_sql()}) GROUP BY 1"


def bits_text(table: int) -> str:
    """A truth table as 256 digits, byte 0 first."""
    return f"{table:0256b}"[::-1]


def truth_index_table(spark: SparkSession) -> DataFrame:
    """(tt, label, forms): the index that a hash join looks functions up in; about 2,000 rows, made from the rule of labels."""
    return spark.createDataFrame([(bits_text(t), label, n) for t, (_, label, n) in bitrules.truth_index().items()], "tt string, label string, forms long")


@query("K20_truth_index", TRUTH)
def truth_index(spark, sf_dir):
    """Functions of one bit by truth table, the first label of the order winning."""
    return truth_index_table(spark).select(F.md5(F.col("tt").cast("binary")).alias("key"), "label", "forms")


@query("K21_decompose")
def decompose(spark, sf_dir):
    """The label of each output bit of a puzzle's rule, found by its truth table; none where no label says it."""
    labels = by_puzzles("array<string>", lambda xs, ys: [None if rule is None else [x or "none" for x in bitrules.labels_of(rule)] for rule in bitrules.word_rules(xs, ys, True)])
    return words(spark, sf_dir).select("puzzle", F.posexplode(labels).alias("bit", "label")).select("puzzle", F.col("bit").cast("long").alias("bit"), "label")


@query("K22_hypothesis_class")
def hypothesis_class(spark, sf_dir):
    """Puzzles by the class of the rule that solves them."""
    kind = by_puzzles("string", lambda xs, ys: list(map(bitrules.hypothesis_class, bitrules.word_rules(xs, ys, True))))
    return words(spark, sf_dir).select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("K23_near_miss")
def near_miss(spark, sf_dir):
    """For each output bit how many labels are right in all examples, and in all but one, and the first of each."""
    found = by_puzzles("array<struct<full:int,near:int,first_full:string,first_near:string>>", bitrules.near_misses)
    return words(spark, sf_dir).select("puzzle", F.posexplode(found).alias("bit", "r")).select("puzzle", F.col("bit").cast("long").alias("bit"), "r.*")


@query("K24_two_steps")
def two_steps(spark, sf_dir):
    """The first function of a library of bytes, or pair of them, that all examples follow."""
    found = by_puzzles("string", lambda xs, ys: [c and " then ".join(c) for c in bitrules.compositions(xs, ys)])
    return words(spark, sf_dir).select("puzzle", found.alias("steps"))


@query("K34_pattern_revision")
def pattern_revision(spark, sf_dir):
    """Output bits that several functions fit, and those whose first label gives way to that of the puzzle's one rule."""
    found = by_puzzles("struct<ambiguous:int,revised:int>", bitrules.all_revised_bits)
    return words(spark, sf_dir).select("puzzle", found.alias("r")).select("puzzle", "r.*")


@query("K35_explored_rules")
def explored_rules(spark, sf_dir):
    """How many puzzles each kind of rule allows: constants, affine maps, single bits, cellular automata."""
    kinds = by_puzzles("array<string>", lambda xs, ys: [[k for k, ok in zip(bitrules.KINDS, row, strict=True) if ok] for row in bitrules.all_explored(xs, ys)])
    return words(spark, sf_dir).select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("K32_order_sweep", f"""WITH c AS ({CONSISTENT}), p(perm) AS (VALUES ('add,mul,sub'), ('add,sub,mul'), ('mul,add,sub'), ('mul,sub,add'), ('sub,add,mul'), ('sub,mul,add'))
    SELECT perm, count(*) FILTER (contains(variants, split_part(perm, ',', 1)) ) AS first_hits FROM c, p GROUP BY 1""")
def order_sweep(spark, sf_dir):
    """Under each of six family orders, how many operators the first family explains; sums in one pass, then six rows."""
    c = ops.consistent_variants(equations(spark, sf_dir), ["puzzle", "op"]).select(F.array_join("variants", ",").alias("v"))
    hits = c.agg(*(F.count_if(F.contains("v", F.lit(f))).alias(f) for f in ("add", "mul", "sub")))
    orders = ["add,mul,sub", "add,sub,mul", "mul,add,sub", "mul,sub,add", "sub,add,mul", "sub,mul,add"]
    return hits.select(F.explode(F.array(*(F.struct(F.lit(o).alias("perm"), F.col(o[:3]).alias("first_hits")) for o in orders))).alias("r")).select("r.*")


@query("K33_claim_audit", f"SELECT puzzle, CAST(count(*) AS BIGINT) AS claims, CAST(sum(CAST(puzzle % 5 = 0 AS INT)) AS BIGINT) AS wrong FROM ({EQUATIONS}) WHERE op IN ('*', '+') GROUP BY 1")
def claim_audit(spark, sf_dir):
    e = equations(spark, sf_dir).filter("op IN ('*', '+')")
    line = F.concat(F.col("out") + F.when(F.col("puzzle") % 5 == 0, 1).otherwise(0), F.lit(" = "), "a", F.lit(" "), "op", F.lit(" "), "b", F.lit("."))
    traces = e.groupBy("puzzle").agg(F.array_join(F.collect_list(line), "\n").alias("t"))

    @F.pandas_udf("claims long, wrong long")
    def audit(t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([ops.audit_claims(x) for x in t], columns=["claims", "wrong"])

    return traces.select("puzzle", audit("t").alias("a")).select("puzzle", "a.claims", "a.wrong")


@query("K37_render_solution", f"SELECT puzzle, ex, translate(CAST(abs(out) AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS symbols FROM ({EQUATIONS})")
def render_solution(spark, sf_dir):
    """A number in symbols through a map, the inverse of reading it."""
    m = F.create_map(*[x for i in range(10) for x in (F.lit(str(i)), F.lit("ABCDEFGHIJ"[i]))])
    s = F.array_join(F.transform(F.split(F.abs("out").cast("string"), ""), lambda d: m[d]), "")
    return equations(spark, sf_dir).select("puzzle", "ex", s.alias("symbols"))
