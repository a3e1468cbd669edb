"""Vector codes against plain loops over whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def slow(rows, parts=8, entries=16, rounds=6):
    """{row number: (code, error, label_error)} and the digest of the codebooks; rows are (id, vector, label) without repeated ids."""
    kept = [(i, [int(x) * 4096 if abs(x) >= 2.0**53 else math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max((len(v) for _, v, _ in kept), default=0)
    width = -(-dims // parts)
    kept = sorted(((i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, p: min((far(part(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        held = [[[] for _ in b] for b in books]
        for _, v, _ in kept:
            for p in range(parts):
                held[p][best(v, p)[1]].append(part(v, p))
        books = [[[sum(c) // len(h) for c in zip(*h, strict=True)] if h else c0 for h, c0 in zip(held[p], books[p], strict=True)] for p in range(parts)]
    out, by_label = [], {}
    for i, v, label in kept:
        found = [best(v, p) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(f for f, _ in found), label))
        by_label[label] = by_label.get(label, 0) + out[-1][2]
    told = [(i, code, error if error <= codes.LONG else None, by_label[label] if by_label[label] <= codes.LONG else None) for i, code, error, label in out]
    return told, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def check(spark, rows, **other):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name, value in other.items():
        table = table.withColumn(name, F.lit(value))
    got, books = codes.compress(table)
    want, digest = slow(rows)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert codes.digest(books) == digest
    return want


def some(rng, n, dims=16, labels=4):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)], rng.randrange(labels) or None) for i in range(n)]


def test_equals_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 160)
    rows = some(random.Random(1), 130)
    bad = [(-1, None, 1), (-2, [None] * 16, 1), (-3, [0.0] * 15 + [float("nan")], 1), (-4, [float("-inf")] + [0.0] * 15, None)]
    check(spark, rows + bad, id=5, x="clash", code=1, __label=2)


def test_ties_repeats_and_null_ids(spark):
    rows = [(i, [float(i % 3)] * 8, None if i % 2 else 7) for i in range(40)] + [(None, [9.0] * 8, 7), (None, [8.5] * 8, 1), (3, [1.0] * 8, 1), (3, [1.0] * 8, 1)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got, books = codes.compress(table)
    want, digest = slow(rows)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key) and codes.digest(books) == digest


@pytest.mark.parametrize("n", [1, 2, 15, 17])
def test_few_rows(spark, n):
    check(spark, some(random.Random(n), n, dims=8))


def test_lengths_that_differ_are_filled_with_zeros(spark):
    check(spark, [(0, [1.0] * 5, 1), (1, [2.0] * 11, 1), (2, [], None), (3, [0.5] * 8, None)])
    check(spark, [(0, [], 1), (1, [], 1)])


def test_numbers_beyond_64_bits(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([1e18, -3e25, 2.5, 1e300]) * rng.random() for _ in range(8)], i % 2) for i in range(30)]
    want = check(spark, rows)
    assert any(r[2] is None for r in want)
    check(spark, [(i, [2e9 * rng.random() for _ in range(8)], 1) for i in range(30)])


def test_empty_and_none_kept(spark):
    for rows in ([], [(1, None, 1), (2, [float("inf")], 2)]):
        got, books = codes.compress(spark.createDataFrame(rows, SCHEMA))
        assert got.columns == ["vec_id", "code", "error", "label_error"] and got.count() == 0
        assert codes.digest(books) == hashlib.sha256(b"").hexdigest()


def test_many_labels_meet_in_salted_places(spark, monkeypatch):
    monkeypatch.setattr(codes, "BROADCAST", 1)
    check(spark, some(random.Random(5), 60, dims=8, labels=30))


def test_integers_take_the_narrowest_kind_and_floor_down():
    assert codes.integers(np.array([[-0.0001, 1.0]]), 4096).tolist() == [[-1, 4096]]
    assert [codes.integers(np.array([[v]]), 4096).dtype.char for v in (1.0, 100.0, 1e9, 1e30)] == ["h", "i", "l", "O"]
    for kind in (1.0, 100.0, 1e9, 1e30):
        x = codes.integers(np.array([[kind, -kind, 0.5], [1.0, 2.0, 3.0]]), 4096)
        assert (codes.unpacked(codes.packed(x), 2, 3, object) == x).all()


def test_other_parameters(spark):
    rows = some(random.Random(8), 50, dims=12)
    got, books = codes.compress(spark.createDataFrame(rows, SCHEMA), parts=3, entries=4, rounds=2)
    want, digest = slow(rows, 3, 4, 2)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and codes.digest(books) == digest
    with pytest.raises(ValueError, match="power of two"):
        codes.compress(spark.createDataFrame(rows, SCHEMA), scale=1000)
