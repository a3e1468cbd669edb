"""Sums over overlapping intervals, against all pairs; no pair is a row of the plan."""

import random

from tracewright.operators import ranges


def test_totals_are_those_of_all_pairs(spark):
    rng = random.Random(9)
    make = lambda n, width: [(i, low, low + rng.choice([-1, 0, 1, 2, width])) for i in range(n) for low in [rng.randrange(-40, 60)]]
    left, right = make(60, 300), make(80, 25)
    left += [(100 + i, 5, 9) for i in range(4)]
    right += [(200, None, 3), (201, 7, 7), (202, 7, 7)]
    got = ranges.overlap_totals(spark.createDataFrame(left, "id long, low long, high long"), spark.createDataFrame(right, "o long, l long, h long"), ("low", "high"), ("l", "h"), "o")
    want = {}
    for i, low, high in left:
        met = [o for o, l, h in right if l is not None and l <= h and low <= high and low <= h and l <= high]
        if met:
            want[i] = (low, high, len(met), min(met))
    assert {r["id"]: tuple(r)[1:] for r in got.collect()} == want and got.count() == len(want)


def test_a_wide_interval_costs_no_pairs(spark):
    # 4 * 10^9 pairs: all of 20,000 wide intervals hold all of 200,000 narrow ones
    wide = spark.range(20000).selectExpr("id", "-id AS low", "1000000 + id AS high")
    narrow = spark.range(200000).selectExpr("id AS o", "id AS l", "id + 1 AS h")
    rows = ranges.overlap_totals(wide, narrow, ("low", "high"), ("l", "h"), "o").groupBy("n", "first").count().collect()
    assert [tuple(r) for r in rows] == [(200000, 0, 20000)]
