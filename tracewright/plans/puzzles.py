"""Puzzles made, solved, stored and checked."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import starmap

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import audits, bitrules, cipherjoins, harvest, numeric, puzzles, symbols
from tracewright.operators import solve as ops
from tracewright.operators.ciphers import COUNT, fixpoints, hall_groups, has_room, matchable, solve_all, solve_under_both, subset_cuts
from tracewright.plans.features import prompts
from tracewright.plans.inputs import equations, table
from tracewright.plans.registry import query
from tracewright.plans.solving import collected, rule_column, words
from tracewright.sources.files import materialised

#: Seeds whose puzzles are made and solved together.
TOGETHER = 2500
SIGN_FAMILIES = {"*": ["mul"], "+": ["add"], "-": ["absdiff"], "$": ["mul_p1"], "#": ["sub_signed"], "&": ["add_m1"]}


def per_row(kind: str, f, *columns: str) -> Column:
    """f of each row's columns, over Arrow batches."""

    return F.pandas_udf(lambda *series: collected(kind, [f(*row) for row in zip(*(s.tolist() for s in series), strict=True)]), kind)(*columns)


def per_batch(kind: str, f, column: str) -> Column:
    """f of all values of a column in an Arrow batch."""

    return F.pandas_udf(lambda texts: collected(kind, f(texts.tolist())), kind)(column)


def stored(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = tuple(puzzles.KINDS), solved: bool = True) -> DataFrame:
    """A puzzle of each of the kinds for each part, with a stored answer and trace (null where nothing is solved). By a hash of its text one in eight has another answer, one in eight another first result."""
    seeds = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seed"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seeds = pdf["seed"].tolist()
            for at in range(0, len(seeds), TOGETHER):
                drawn = [(seed, kind, p["prompt"], p["answer"]) for seed in seeds[at : at + TOGETHER] for kind in kinds if (p := puzzles.construct(seed, kind))]
                found = harvest.blind_all([kind for _, kind, *_ in drawn], [prompt for *_, prompt, _ in drawn]) if solved else [(None, None)] * len(drawn)
                yield pd.DataFrame([(*row, *solution) for row, solution in zip(drawn, found, strict=True)], columns=["seed", "kind", "prompt", "answer", "box", "trace"])

    tasks = 4 * spark.sparkContext.defaultParallelism
    made = seeds.repartition(tasks, "seed").mapInPandas(run, "seed long, kind string, prompt string, answer string, box string, trace string")
    fault = F.pmod(F.xxhash64("prompt"), F.lit(8))
    spoilt = F.regexp_replace("prompt", r"^([^=]*= )(\d)", "$17$2")
    return made.withColumn("answer", F.when(fault == 0, F.concat(F.lit("1"), "answer")).otherwise(F.col("answer"))).withColumn("prompt", F.when((fault == 1) & ~F.col("kind").isin("bit", "symbol"), spoilt).otherwise(F.col("prompt")))


def numeric_rows(spark: SparkSession, sf_dir: str, solved: bool = True) -> DataFrame:
    return stored(spark, sf_dir, tuple(k for k in puzzles.KINDS if k not in ("bit", "symbol")), solved)


def all_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, prompt): orders' equations as prompts, and constructed puzzles."""
    own = prompts(spark, sf_dir).select(F.concat(F.lit("order "), "puzzle").alias("id"), "prompt")
    return own.unionByName(numeric_rows(spark, sf_dir, False).select(F.concat("kind", F.lit(" "), "seed").alias("id"), "prompt")).repartition(4 * spark.sparkContext.defaultParallelism, "id")


@query("K6_classify")
def classify(spark, sf_dir):
    """Each prompt's label, one of eight."""
    return all_prompts(spark, sf_dir).select("id", per_row("string", lambda p: numeric.classify(numeric.parse(p)), "prompt").alias("label"))


def _solved(prompt: str) -> dict:
    puzzle = numeric.parse(prompt)
    if puzzle is None:
        return {"answer": None, "reading": None, "how": "noparse", "trace": None}
    s = numeric.solve(puzzle)
    return {"answer": s.answer, "reading": "leftward" if s.leftward else "rightward", "how": s.how, "trace": s.trace}


@query("K8_numeric_trace")
def numeric_trace(spark, sf_dir):
    """Answer, reading and forward trace of each prompt: readings, signs, digit counts, families, gates and the query."""
    found = per_row("struct<answer:string,reading:string,how:string,trace:string>", _solved, "prompt")
    return all_prompts(spark, sf_dir).select("id", found.alias("s")).select("id", "s.*")


@query("P7_axes")
def axes(spark, sf_dir):
    """Prompts by label, reading, signs, leading zeros, operators and source."""

    def of(prompt: str) -> dict:
        p = numeric.parse(prompt)
        if p is None:
            return {"label": "no_rule_fits", "reading": None, "signed": None, "leading_zero": None, "n_ops": None}
        numbers = [x for a, _, b, out in p.examples for x in (a, b, out)] + [p.query[0], p.query[2]]
        return {"label": numeric.classify(p), "reading": "leftward" if numeric.reading_of(p) else "rightward", "signed": any(numeric.is_signed(out) for *_, out in p.examples), "leading_zero": any(len(x) > 1 and x[0] == "0" for x in numbers), "n_ops": len(p.operators)}

    found = all_prompts(spark, sf_dir).select(F.split("id", " ")[0].alias("source"), per_row("struct<label:string,reading:string,signed:boolean,leading_zero:boolean,n_ops:int>", of, "prompt").alias("a"))
    return found.select("source", "a.*").groupBy("source", "label", "reading", "signed", "leading_zero", "n_ops").agg(F.count("*").alias("n"))


@query("V10_invariants")
def invariants(spark, sf_dir):
    """Stored puzzles by the hard rules that they break; by a hash some have a sign more in the answer or in an example, or an empty box."""
    label = per_row("string", lambda p: numeric.classify(numeric.parse(p)), "prompt")
    fault = F.pmod(F.xxhash64("prompt", F.lit("V10")), F.lit(9))
    rows = numeric_rows(spark, sf_dir).withColumn("label", label).withColumn("answer", F.when(fault == 0, F.concat(F.lit("-"), F.regexp_replace("answer", r"\D", ""))).otherwise(F.col("answer"))).withColumn("box", F.when(fault == 1, "").otherwise(F.col("box")))
    rows = rows.withColumn("prompt", F.when(fault == 2, F.regexp_replace("prompt", r"(?m)= (\d+)$", "= -$1")).otherwise(F.col("prompt")))
    broken = audits.violations(*map(F.col, ("prompt", "answer", "box", "label", "kind")))
    return rows.select("seed", "kind", F.explode(broken).alias("violation")).groupBy("violation").agg(F.count("*").alias("n"), F.min("seed").alias("first"))


@query("V11_soundness")
def soundness(spark, sf_dir):
    """Whether the rule that was selected for a puzzle of bytes reproduces every example, one of which may have been spoilt since."""
    rows = words(spark, sf_dir).withColumn("rule", rule_column(True))
    spoilt = F.transform("ys", lambda y, i: F.when((i == 0) & (F.pmod(F.xxhash64("puzzle", F.lit("spoilt")), F.lit(5)) == 0), y.bitwiseXOR(F.lit(1))).otherwise(y))
    sound = per_row("boolean", lambda rule, xs, ys: None if rule is None else all(bitrules.apply_rule(rule, int(x)) == y for x, y in zip(xs, ys, strict=True)), "rule", "xs", "ys")
    return rows.withColumn("ys", spoilt).select("puzzle", "rule", "xs", "ys").withColumn("sound", sound)


@query("V12_independent_check")
def independent_check(spark, sf_dir):
    """Stored traces read and worked out again, by code that shares nothing with the solver."""
    status = per_row("string", audits.verify_trace, "prompt", "answer", "trace")
    return numeric_rows(spark, sf_dir).select("seed", "kind", status.alias("status"))


@query("V13_reproduction")
def reproduction(spark, sf_dir):
    """Whether solving a stored puzzle again gives its stored box and trace."""
    solve = lambda kinds, prompts: [{"box": box, "trace": trace} for box, trace in harvest.blind_all(kinds.tolist(), prompts.tolist())]
    again = F.pandas_udf(lambda kinds, prompts: collected("struct<box:string,trace:string>", solve(kinds, prompts)), "struct<box:string,trace:string>")("kind", "prompt")
    rows = stored(spark, sf_dir).withColumn("again", again)
    return rows.select("seed", "kind", (F.col("box") == F.col("again.box")).alias("same_box"), (F.col("trace") == F.col("again.trace")).alias("same_trace"))


@query("B17_harvest")
def harvested(spark, sf_dir):
    """Puzzles made and solved blind, in rounds sized by the yield so far, until each kind has its quota; the quota is the operator."""
    return harvest.harvest(spark, {"numeric": 300, "symbol": 200, "fallback": 100, "ambiguous": 150}, materialised).select("kind", "seed", "prompt", "answer")


@query("B18_yield")
def yields(spark, sf_dir):
    """Of a run of numbers, how many give a puzzle of each kind, and how many of these are solved right."""
    n = table(spark, sf_dir, "part").count()
    return harvest.made(spark, 0, n, puzzles.KINDS, labelled=False).groupBy("kind").agg(F.count("*").alias("made"), F.round(F.avg((F.col("box") == F.col("answer")).cast("int")), 6).alias("rate"))


@query("B19_construct_puzzles")
def construct_puzzles(spark, sf_dir):
    """Puzzles of six kinds, one of each for each part."""
    return harvest.made(spark, 0, table(spark, sf_dir, "part").count(), puzzles.KINDS, solved=False).select("seed", "kind", "prompt", "answer", "detail", "label")


# ciphers: numbers of equations under letters


def ciphers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ciphered puzzles; solving is a tree search, so a puzzle is a row with its equations in an array, and rows go to many tasks."""
    letters = lambda c: F.translate(F.abs(c).cast("string"), "0123456789", "ABCDEFGHIJ")
    out = F.concat(F.when(F.col("out") < 0, "-").otherwise(""), letters("out"))
    g = equations(spark, sf_dir).groupBy("puzzle").agg(F.array_sort(F.collect_list(F.struct("ex", letters("a").alias("a"), "op", letters("b").alias("b"), out.alias("out")))).alias("e"))
    return g.repartition(4 * spark.sparkContext.defaultParallelism, "puzzle")


def cipher_of(e, budget: int = symbols.BUDGET) -> ops.Cipher:
    eqs = [(x["a"], x["op"], x["b"], x["out"]) for x in e]
    return ops.Cipher(eqs, {op: SIGN_FAMILIES[op] for _, op, _, _ in eqs}, budget=budget)


def solved_together(f, schema: str):
    """Rows of f, which takes the equations of a batch of puzzles and gives what follows each puzzle's number."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, *row) for p, row in zip(pdf["puzzle"], f(pdf["e"].tolist()), strict=True)], columns=names)

    return run


def planted(solution: dict[str, int]) -> bool:
    return all(v == ord(k) - 65 for k, v in solution.items())


@query("K10_cipher_search")
def cipher_search(spark, sf_dir):
    """Narrowing, propagation and branching of each cipher: up to two solutions, and whether the planted digits are the first or second."""

    def run(es):
        return [(len(c.found), c.nodes > c.budget, any(planted(s) for s, _ in c.found), c.nodes) for c in solve_all(list(map(cipher_of, es)))]

    schema = "puzzle long, solutions int, budget_met boolean, has_planted boolean, nodes int"
    return ciphers(spark, sf_dir).mapInPandas(solved_together(run, schema), schema)


def fixed_together(es, f, alone) -> list:
    """f(start, after, alive, ciphers) of the fixpoints of a batch's puzzles, by letter and puzzle, some at a time; None of it, and what has no room in arrays, is worked out alone."""
    ciphers = list(map(cipher_of, es))
    rows: list = [None] * len(ciphers)
    room = [k for k, c in enumerate(ciphers) if has_room(c)]
    for at in range(0, len(room), 5000):
        some = room[at : at + 5000]
        for k, row in zip(some, f(*fixpoints([ciphers[k] for k in some]), [ciphers[k] for k in some]), strict=True):
            rows[k] = row
    return [alone(c) if row is None else row for c, row in zip(ciphers, rows, strict=True)]


@query("K11_propagation")
def propagation(spark, sf_dir):
    """Digits left in the domains at the start, after the fixpoint and after subsets, what each rule took, and whether the planted digits are still there."""

    def alone(c: ops.Cipher):
        domain = c.start()
        size = lambda: sum(map(len, domain.values()))
        before = size()
        ok = len(domain) <= 10 and c._propagate(domain, {k: list(v) for k, v in c.families.items()})
        after = size()
        subsets = ops.subset_cuts(domain) if ok else 0
        sound = ok and all(ord(x) - 65 in d for x, d in domain.items())
        return before, after, subsets, bool(sound), ops.hall_violator(list(domain.values())) is None

    def together(start, domain, alive, ciphers):
        there = start != 0
        before, after = COUNT[start].sum(0), COUNT[domain].sum(0)
        cuts = subset_cuts(domain, there)
        matched = matchable(domain, there)
        masks = domain.T.tolist()
        sound = [all(m >> (ord(x) - 65) & 1 for x, m in zip(c.letters(), row, strict=False)) for c, row in zip(ciphers, masks, strict=True)]
        # what is left where a domain runs empty depends on the order of the rules
        return [row if ok else None for ok, row in zip(alive, zip(before.tolist(), after.tolist(), cuts.tolist(), sound, matched.tolist(), strict=True), strict=True)]

    schema = "puzzle long, before int, after int, subset_cuts int, sound boolean, matchable boolean"
    return ciphers(spark, sf_dir).mapInPandas(solved_together(lambda es: fixed_together(es, together, alone), schema), schema)


@query("K28_hall_search")
def hall_search(spark, sf_dir):
    """Letters that share too few digits once one letter is given a digit that it can't have: found by a Hall violator, and counted."""

    def alone(c: ops.Cipher):
        domain = c.start()
        if len(domain) > 10 or not c._propagate(domain, {k: list(v) for k, v in c.families.items()}):
            return 0, 0
        refuted = largest = 0
        for x in sorted(domain):
            for v in sorted(domain[x]):
                rest = [{v} if y == x else d - {v} for y, d in sorted(domain.items())]
                group = ops.hall_violator(rest)
                refuted += group is not None
                largest = max(largest, len(group or ()))
        return refuted, largest

    def together(start, domain, alive, ciphers):
        refuted, largest = hall_groups(domain, start != 0)
        return [row if ok else (0, 0) for ok, row in zip(alive, zip(refuted.tolist(), largest.tolist(), strict=True), strict=True)]

    schema = "puzzle long, refuted int, largest int"
    return ciphers(spark, sf_dir).mapInPandas(solved_together(lambda es: fixed_together(es, together, alone), schema), schema)


def symbol_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, ("symbol",), False)


@query("K13_family_search")
def family_search(spark, sf_dir):
    """Symbol puzzles by the combinations of families tried, in order, and the first that has digits."""

    def of(found: symbols.Found) -> dict:
        return {"tried": len(found.tried), "first": " ".join(found.tried[-1]) if found.digits and found.tried else None, "nodes": found.nodes}

    every = lambda texts: list(map(of, symbols.assign_all(list(map(symbols.parse, texts)), False)))

    return symbol_rows(spark, sf_dir).select("seed", per_batch("struct<tried:int,first:string,nodes:int>", every, "prompt").alias("f")).select("seed", "f.*")


@query("K14_symbol_trace")
def symbol_trace(spark, sf_dir):
    """Answer, reading and trace of symbol puzzles."""

    def of(s: symbols.SymbolSolution) -> dict:
        return {"answer": s.answer, "reading": "leftward" if s.little_endian else "rightward", "how": s.how, "trace": s.trace}

    return symbol_rows(spark, sf_dir).select("seed", per_batch("struct<answer:string,reading:string,how:string,trace:string>", lambda texts: list(map(of, symbols.solve_prompts(texts))), "prompt").alias("s")).select("seed", "s.*")


@query("K15_solution_classes")
def solution_classes(spark, sf_dir):
    """Ciphers with one solution, with more, with none, and those whose first result puts its operands together; counted up to two. What has no room in the tables of equations is searched."""

    def run(es):
        kinds = ["concat"] * len(es)
        joined, searched = {}, {}
        for k, e in enumerate(es):
            if e[0]["out"] not in (e[0]["a"] + e[0]["b"], e[0]["b"] + e[0]["a"]):
                equations = [(x["a"], x["op"], x["b"], x["out"]) for x in e]
                families = {op: SIGN_FAMILIES[op] for _, op, _, _ in equations}
                if cipherjoins.has_room(equations, families):
                    joined[k] = (equations, families)
                else:
                    searched[k] = ops.Cipher(equations, families, budget=3_000_000)
        for k, n in zip(joined, cipherjoins.solution_counts(list(joined.values())).tolist(), strict=True):
            kinds[k] = ("none", "unique", "multi")[n]
        solve_all(list(searched.values()))
        for k, c in searched.items():
            kinds[k] = "budget met" if c.nodes > c.budget and len(c.found) < 2 else ("none", "unique", "multi")[len(c.found)]
        return [(kind,) for kind in kinds]

    schema = "puzzle long, class string"
    return ciphers(spark, sf_dir).mapInPandas(solved_together(run, schema), schema).groupBy("class").agg(F.count("*").alias("n"))


@query("K31_early_stop")
def early_stop(spark, sf_dir):
    """What stopping at a complete first reading saves in nodes and letters of the trace, and whether it changes the answer."""

    def of(full: symbols.SymbolSolution, short: symbols.SymbolSolution) -> dict:
        return {"fired": len(short.trace) < len(full.trace), "letters_saved": len(full.trace) - len(short.trace), "changed": full.answer != short.answer}

    return symbol_rows(spark, sf_dir).select("seed", per_batch("struct<fired:boolean,letters_saved:int,changed:boolean>", lambda texts: list(starmap(of, symbols.solve_both(texts))), "prompt").alias("s")).select("seed", "s.*")


@query("K26_budget")
def budget(spark, sf_dir):
    """Ciphers under a small budget of nodes: what stays unsolved is a row that says so, and is solved under the full one."""

    def run(es):
        fulls = list(map(cipher_of, es))
        shorts = solve_under_both(fulls, 20)
        return [("solved" if found else "budget met" if nodes > 20 else "none", nodes, c.nodes, bool(c.found)) for (nodes, found), c in zip(shorts, fulls, strict=True)]

    schema = "puzzle long, short string, short_nodes int, full_nodes int, solved boolean"
    return ciphers(spark, sf_dir).mapInPandas(solved_together(run, schema), schema)
