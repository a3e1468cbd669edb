"""Operators that SQL can't say, against plain loops; and sources that keep what they are given."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import balance, bitrules, merge, ranges, report, rewards, solve
from tracewright.sources import files


def brute(equations, families):
    letters = sorted({c for e in equations for w in (e[0], e[2], e[3]) for c in w})
    lead = {w[0] for e in equations for w in (e[0], e[2], e[3]) if len(w) > 1}
    n = 0
    for p in itertools.permutations(range(10), len(letters)):
        m = dict(zip(letters, p))
        value = lambda w: int("".join(str(m[c]) for c in w))  # noqa: B023, E731
        if not any(m[c] == 0 for c in lead) and all(solve.number(families[o][0], value(a), value(b)) == value(out) for a, o, b, out in equations):
            n += 1
    return n


def test_cipher_counts_all_solutions():
    for a, b, variant in ((12, 21, "add"), (12, 3, "mul"), (31, 13, "absdiff")):
        t = lambda n: str(n).translate(str.maketrans("0123456789", "ABCDEFGHIJ"))
        e = [(t(a), "?", t(b), t(solve.number(variant, a, b)))]
        c = solve.Cipher(e, {"?": [variant]})
        assert len(c.solve(10**6)) == brute(e, {"?": [variant]}) and c.nodes <= c.budget


def test_word_rule_reproduces_its_examples():
    rng = random.Random(5)
    for name in rng.sample(solve.UNARY, 12):
        xs = [rng.randrange(256) for _ in range(8)]
        rule = bitrules.word_rule(xs, [solve.unary_number(name, x) for x in xs])
        assert rule in solve.UNARY and all(solve.unary_number(rule, x) == solve.unary_number(name, x) for x in xs)
    xs = [rng.randrange(256) for _ in range(9)]
    both = [solve.unary_number("rotl3", x) ^ x for x in xs]
    assert bitrules.word_rule(xs, both) == "XOR(id,rotl3)"


def test_unary_columns_and_numbers_agree(spark):
    row = spark.range(256).select("id", *(solve.unary(n, F.col("id").cast("int")).alias(n) for n in solve.UNARY)).collect()
    assert all(r[n] == solve.unary_number(n, r["id"]) for r in row for n in solve.UNARY)


def test_greedy_cover_covers_everything_within_quota(spark):
    df = spark.createDataFrame([(1, "g", ["a", "b"]), (2, "g", ["b"]), (3, "g", ["c"]), (4, "h", ["x"]), (5, "h", ["x"])], "id long, grp string, items array<string>")
    got = {(r["grp"], r["id"]) for r in balance.greedy_cover(df, "id", "items", "grp", 9).collect()}
    assert got == {("g", 1), ("g", 3), ("h", 4)}


def test_rate_balance_keeps_the_rate(spark):
    df = spark.range(300).select("id", F.lit("g").alias("grp"), (F.col("id") % 2 == 0).alias("flag"))
    rows = balance.balance_rate(df, "id", "flag", "grp", 0.34, 100).collect()
    assert len(rows) == 100 and sum(r["flag"] for r in rows) == 34


def test_rate_balance_against_a_loop(spark):
    rng = random.Random(31)
    rows = [(i, rng.choice("abc"), rng.random() < 0.6) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, grp string, flag boolean").repartition(5)
    got = sorted((r["grp"], r["id"]) for r in balance.balance_rate(df, "id", "flag", "grp", 0.34, 90).collect())
    want = []
    for g in "abc":
        taken = hits = 0
        for i, h, f in rows:
            if h == g and taken < 90 and f == (hits < 0.34 * (taken + 1)):
                want.append((g, i))
                taken, hits = taken + 1, hits + f
    assert got == sorted(want)


@pytest.mark.parametrize("pieces", [1, 2, 7, 40])
def test_rate_balance_for_every_cut(spark, pieces):
    rng = random.Random(pieces)
    rows = [(i, rng.choice("aaaaab"), rng.random() < 0.5 if i % 10 else None) for i in range(400)] + [(7, None, True)]
    df = spark.createDataFrame(rows, "id long, grp string, flag boolean").repartition(3)
    got = sorted((r["grp"], r["id"]) for r in balance.balance_rate(df, "id", "flag", "grp", 0.7, 25, pieces).collect())
    want = []
    for g in "ab":
        taken = hits = 0
        for i, h, f in rows:
            if h == g and taken < 25 and bool(f) == (hits < 0.7 * (taken + 1)):
                want.append((g, i))
                taken, hits = taken + 1, hits + bool(f)
    assert got == sorted(want)
    assert balance.balance_rate(df.limit(0), "id", "flag", "grp", 0.7, 25, pieces).count() == balance.balance_rate(df, "id", "flag", "grp", 0.7, 0, pieces).count() == 0


def slow_cover(rows, quota):
    """{group: chosen ids in order}; rows are (id, group, items)."""
    out = {}
    for g in {r[1] for r in rows if r[1] is not None}:
        mine = [(i, {x for x in items or [] if x is not None}) for i, h, items in rows if h == g]
        count = lambda x: sum(x in s for _, s in mine)  # noqa: B023, E731
        covered, chosen = set(), []
        for x in sorted({x for _, s in mine for x in s}, key=lambda x: (count(x), x)):
            if x not in covered and len(chosen) < quota:
                best = max((r for r in mine if x in r[1]), key=lambda r: (len(r[1] - covered), -r[0]))
                chosen.append(best[0])
                covered |= best[1]
        if chosen:
            out[g] = chosen
    return out


@pytest.mark.parametrize(("items", "quota", "broadcast"), [(9, 100, 100), (90, 6, 100), (200, 100, 0)])
def test_cover_of_many_items_against_a_loop(spark, monkeypatch, items, quota, broadcast):
    monkeypatch.setattr(balance, "BROADCAST", broadcast)
    monkeypatch.setattr(balance, "PRUNE", 2)
    rng = random.Random(items)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", "c"]), sorted({f"i{int(rng.random() ** 3 * items)}" for _ in range(rng.randrange(items // 4 + 2))})) for i in range(150)]
    rows += [(500, None, ["x"]), (501, "d", []), (502, "e", None), (503, "b", ["i1", None, "i1"]), (504, "f", ["y"]), (505, "f", ["y"])]
    df = spark.createDataFrame(rows, "id long, grp string, items array<string>").repartition(3)
    got = balance.greedy_cover(df, "id", "items", "grp", quota).orderBy("place").collect()
    found = {}
    for r in got:
        found.setdefault(r["grp"], []).append(r["id"])
    assert found == slow_cover(rows, quota)


def test_cover_then_fill_against_a_loop(spark):
    rng = random.Random(32)
    rows = [(i, rng.choice("gh"), rng.choice(["p", "q", "r"]), sorted(rng.sample("abcdefghij", rng.randrange(1, 4)))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, grp string, kind string, items array<string>")
    for quota in (3, 25, 500):
        got = {(r["grp"], r["id"]): r["phase"] for r in balance.cover_then_fill(df, "id", "items", "grp", "kind", quota).collect()}
        for g in "gh":
            mine = [r for r in rows if r[1] == g]
            count = lambda x: sum(x in r[3] for r in mine)  # noqa: B023, E731
            covered, chosen = set(), {}
            for x in sorted({x for r in mine for x in r[3]}, key=lambda x: (count(x), x)):
                if x not in covered and len(chosen) < quota:
                    best = max((r for r in mine if x in r[3]), key=lambda r: (len(set(r[3]) - covered), -r[0]))
                    chosen[best[0]] = 1
                    covered |= set(best[3])
            rest = [r for r in mine if r[0] not in chosen]
            firsts = [min(r[0] for r in rest if r[2] == k) for k in sorted({r[2] for r in rest})]
            for i, phase in [*((i, 2) for i in firsts), *((r[0], 3) for r in rest if r[0] not in firsts)]:
                if len(chosen) < quota:
                    chosen[i] = phase
            assert {i: p for (h, i), p in got.items() if h == g} == chosen


def test_weighted_merge_of_many_columns(spark):
    rng = np.random.default_rng(5)
    rows = [(m, s, k, rng.normal(size=16).tolist()) for m in range(2) for s in range(3) for k in range(40)]
    df = spark.createDataFrame(rows, "module long, step int, k int, embedding array<double>").repartition(7)
    weights = {0: 1.0, 1: 2.0, 2: 0.5}
    got = merge.svd_merge(df, 5, weights).collect()
    for m in range(2):
        whole = sum(weights[r[1]] * np.outer(r[3][:8], r[3][8:]) for r in rows if r[0] == m) / 3.5
        assert np.allclose([r["singular"] for r in sorted(got, key=lambda r: r["k"]) if r["module"] == m], np.linalg.svd(whole)[1][:5])


def test_places_of_counted_values(spark):
    rng = random.Random(33)
    rows = [(g, rng.choice([1, 5, 5, 9, 2000, -3])) for g in "ab" for _ in range(rng.randrange(1, 60))]
    df = spark.createDataFrame(rows, "g string, v int")
    points = {"low": 0.0, "med": 0.5, "p90": 0.9, "high": 1.0}
    for r in report.index_quantile(df, ["g"], "v", points).collect():
        values = sorted(v for g, v in rows if g == r["g"])
        assert [r[p] for p in points] == [values[min(int(len(values) * q), len(values) - 1)] for q in points.values()]


def test_a_replaced_table_is_old_or_new(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    files.replace_table(spark.range(5), path)
    before = files.read_table(spark, path, "id long")
    files.replace_table(spark.range(10, 13), path)
    assert sorted(r["id"] for r in before.collect()) == list(range(5))  # a reader that began before
    assert sorted(r["id"] for r in files.read_table(spark, path, "id long").collect()) == [10, 11, 12]


def test_overlap_join(spark):
    rng = random.Random(1)
    a = [(i, x := rng.randrange(500), x + rng.randrange(90)) for i in range(60)]
    b = [(i, x := rng.randrange(500), x + rng.randrange(90)) for i in range(60)]
    got = ranges.overlap_join(spark.createDataFrame(a, "i long, l long, h long"), spark.createDataFrame(b, "j long, m long, k long"), ("l", "h"), ("m", "k"))
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted((i, j) for i, l, h in a for j, m, k in b if l <= k and m <= h)


def test_overlap_join_of_all_widths(spark):
    rng = random.Random(2)
    some = lambda: (x := rng.randrange(-10**6, 10**6), x + rng.choice([0, 1, 7, 1000, 10**6, 10**9]))
    a, b = [(i, *some()) for i in range(150)], [(i, *some()) for i in range(150)]
    a += [(900, None, 5), (901, 5, None), (902, 9, 3), (903, -(2**40), 2**41), (3, 0, 0), (3, 0, 0)]
    got = ranges.overlap_join(spark.createDataFrame(a, "i long, l long, h long"), spark.createDataFrame(b, "j long, m long, k long"), ("l", "h"), ("m", "k"))
    fine = [x for x in a if x[1] is not None and x[2] is not None and x[1] <= x[2]]
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted((i, j) for i, l, h in fine for j, m, k in b if l <= k and m <= h)


def test_overlap_join_of_fractions_and_empty(spark):
    rng = random.Random(3)
    a = [(i, x := rng.random() * 20 - 10, x + rng.random() * 3) for i in range(80)]
    b = [(i, x := rng.random() * 20 - 10, x + rng.random() * 3) for i in range(80)]
    left, right = spark.createDataFrame(a, "i long, l double, h double"), spark.createDataFrame(b, "j long, m double, k double")
    got = ranges.overlap_join(left, right, ("l", "h"), ("m", "k"))
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted((i, j) for i, l, h in a for j, m, k in b if l <= k and m <= h)
    assert ranges.overlap_join(left.limit(0), right, ("l", "h"), ("m", "k")).count() == 0


def test_blocks_of_an_interval_are_few_and_apart(spark):
    rows = spark.range(-20, 20).selectExpr("id AS l").crossJoin(spark.range(0, 45).selectExpr("id AS w")).select("l", (F.col("l") + F.col("w")).alias("h"))
    for r in rows.select("l", "h", ranges.dyadic_nodes(F.col("l"), F.col("h")).alias("n")).collect():
        held = [x for n in r["n"] for x in range(n["at"] << n["k"], (n["at"] + 1) << n["k"])]
        assert sorted(held) == list(range(r["l"], r["h"] + 1)) and len(r["n"]) <= 2 * (r["h"] - r["l"] + 1).bit_length()


def test_numbered_and_tiles(spark):
    df = ranges.numbered(spark.range(103).select((F.col("id") * 7 % 103).alias("id")), "id", total="rows")
    rows = df.withColumn("t", ranges.tile(F.col("row_no"), F.col("rows"), 10)).collect()
    assert all(r["row_no"] == r["id"] for r in rows)
    assert [sum(r["t"] == i for r in rows) for i in range(1, 11)] == [11, 11, 11] + [10] * 7


def test_index_quantile(spark):
    df = spark.createDataFrame([(1, v) for v in (5, 1, 1, 9)], "k int, v int")
    r = report.index_quantile(df, ["k"], "v", {"a": 0.0, "m": 0.5, "z": 1.0}).first()
    assert (r["a"], r["m"], r["z"]) == (1, 5, 9)


def test_svd_merge_is_exact_at_full_rank(spark):
    rng = np.random.default_rng(0)
    rows = [(0, s, k, rng.normal(size=12).tolist()) for s in range(2) for k in range(2)]
    df = spark.createDataFrame(rows, "module long, step int, k int, embedding array<double>")
    m = sum(np.outer(r[3][:6], r[3][6:]) for r in rows) / 2
    got = [r["singular"] for r in merge.svd_merge(df, 4).orderBy("k").collect()]
    assert np.allclose(got, np.linalg.svd(m)[1][:4])


def test_parse_rewards(spark):
    prompt = "examples:\n12+34 = 46\nNow, determine the result for: 34+12"
    good = "read each equation one symbol\n+ -> f\nEX1 12+34=46 becomes 1 2 + 3 4 = 4 6\nQUERY 34+12 becomes 3 4 + 1 2"
    of = lambda f, p, t: spark.range(1).select(f(F.lit(p), F.lit(t)).alias("s")).first()["s"]
    assert of(rewards.crypt_parse, prompt, good) == 1.5 and of(rewards.equation_parse, prompt, good) == 1.0
    assert of(rewards.crypt_parse, prompt, "nothing") == -0.9 and of(rewards.equation_parse, "", "nothing") == 0.0
    assert rewards.solver_alignment("x", None) == 0.0


def test_claim_audit():
    assert solve.audit_claims("46 = 12+34, 47 = 12 + 34, 409 = 12×34 + 1") == (3, 1)


def test_csv_keeps_fields(spark, tmp_path):
    rows = [("007", 'a "quoted"\nline\\', " x "), ("1e5", "", "t")]
    files.write_csv(spark.createDataFrame(rows, "a string, b string, c string"), f"{tmp_path}/c", ["a", "b", "c"])
    got = sorted((r["a"], r["b"] or "", r["c"]) for r in files.read_csv(spark, f"{tmp_path}/c", ["a", "b", "c"]).collect())
    assert got == sorted(rows)
