"""Puzzles are made and solved as far as a query asks for."""

import random

from tracewright.operators import harvest, numeric
from tracewright.plans import puzzles as plans

SF = "/root/testdata/sf0.001"


def test_kinds_asked_for_are_those_of_all(spark):
    every = {(r["seed"], r["kind"]): r for r in plans.stored(spark, SF).collect()}
    some = plans.stored(spark, SF, ("numeric", "symbol"), False).collect()
    assert {(r["seed"], r["kind"]) for r in some} == {k for k in every if k[1] in ("numeric", "symbol")}
    assert all((r["prompt"], r["answer"]) == (every[r["seed"], r["kind"]]["prompt"], every[r["seed"], r["kind"]]["answer"]) and r["box"] is r["trace"] is None for r in some)


def test_unasked_solutions_and_labels_are_null(spark):
    full = {(r["seed"], r["kind"]): r for r in harvest.made(spark, 0, 12, ["numeric", "bit"]).collect()}
    short = {(r["seed"], r["kind"]): r for r in harvest.made(spark, 0, 12, ["numeric", "bit"], solved=False, labelled=False).collect()}
    assert full.keys() == short.keys()
    for k, r in short.items():
        assert r["box"] is r["trace"] is r["label"] is None and (r["prompt"], r["answer"], r["detail"]) == (full[k]["prompt"], full[k]["answer"], full[k]["detail"])


def test_fitting_variants_by_plain_values():
    rng = random.Random(2)
    for _ in range(3000):
        v = rng.choice(numeric.ARITHMETIC)
        rows = []
        for _ in range(rng.randrange(1, 4)):
            a, b = str(rng.randrange(100)), f"{rng.randrange(100):02d}"
            out = numeric.value(v, a, b)
            rows.append((a, b, rng.choice([out, out, out, "0" + out, out + "#", "-0", "-"])))
        assert numeric.fitting(numeric.ARITHMETIC, rows) == [w for w in numeric.ARITHMETIC if all(numeric.value(w, a, b) == out for a, b, out in rows)]
