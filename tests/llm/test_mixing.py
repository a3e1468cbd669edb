"""The mixing schedule against brute force; takes and order come from the points alone."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.brute import slow_targets
from tracewright.llm import mixing

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def slow_mix(rows, block, step):
    """(taken, first slot, slots) of each row of (h, doc_id, source, size), slot by slot."""
    sizes = collections.Counter()
    for _, _, s, n in rows:
        sizes[s] += n
    goal, circle, fine = slow_targets(sizes), 1 << 32, 1 << 16
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    blocks = {s: -(-sizes[s] // block) for s in names}
    want = {s: math.floor(goal[s] * blocks[s] / sizes[s] * fine + 0.5) if sizes[s] else 0 for s in names}
    whole, at, arcs = sum(want.values()), 0, {}
    for s in names:
        arcs[s] = (int(at / whole * circle), int((at + want[s]) / whole * circle))
        at += want[s]
    streams = {s: [] for s in names}  # of each word of a source its row
    for i in sorted(range(len(rows)), key=lambda i: rows[i][:2] + rows[i][3:]):
        streams[rows[i][2]] += [i] * rows[i][3]
    rank, got = collections.Counter(), [[0, None, 0] for _ in rows]
    for j in range(round(whole / fine)):
        u = j * step % circle
        s = next(s for s in names if arcs[s][0] <= u < arcs[s][1])
        k, rank[s] = rank[s], rank[s] + 1
        if k >= 3 * blocks[s]:
            continue
        b = k % blocks[s]
        words = collections.Counter(streams[s][b * block : (b + 1) * block])
        for i, n in words.items():
            got[i][0] += n
            got[i][1] = j if got[i][1] is None else got[i][1]
            got[i][2] += 1
    return got


def keyed(df):
    size = mixing.word_count(F.col("text"))
    return [(r["h"], r["doc_id"], r["source"], r["size"]) for r in df.select(F.shiftrightunsigned(F.xxhash64(F.lit(13), "doc_id", size), 1).alias("h"), "doc_id", "source", size.alias("size")).collect()]


@pytest.mark.parametrize("block", [37, 512])
def test_rows_are_those_of_the_slots(documents, block):
    rows = keyed(documents)
    want = slow_mix(rows, block, round((math.sqrt(5) - 1) / 2 * 2**32))
    got = {r["doc_id"]: (r["taken"], r["first_slot"], r["slots"]) for r in mixing.mix(documents, block=block).collect()}
    assert got == {d: tuple(w) for (_, d, _, _), w in zip(rows, want, strict=True)}


def test_without_the_points_the_mix_is_another(documents, monkeypatch):
    """With a step of 0 or 1/2 instead of the golden ratio, sources are off their targets."""
    rows = {r["doc_id"]: r for r in mixing.mix(documents).collect()}
    for phi in (0.0, 0.5):
        monkeypatch.setattr(mixing, "PHI", phi)
        other = mixing.mix(documents).collect()
        assert sum(r["taken"] != rows[r["doc_id"]]["taken"] for r in other) > len(other) / 2
        assert sum(r["first_slot"] != rows[r["doc_id"]]["first_slot"] for r in other) > len(other) / 2


def check_mix(rows, texts, off):
    """Sizes by words, targets by brute force, no row over three times its size, sources at most `off` words from their targets."""
    sizes, taken = collections.Counter(), collections.Counter()
    by_id = collections.defaultdict(list)
    for d, t, s in texts:
        n = len(WORDS.findall(t or ""))
        sizes[s] += n
        by_id[d].append((n, s))
    goal = slow_targets(dict(sizes))
    for r in rows:
        size, s = next(x for x in by_id[r["doc_id"]] if x[0] == r["size"])
        assert r["source_size"] == sizes[s] and abs(r["target"] - goal[s]) < 1e-6 and 0 <= r["taken"] <= 3 * size
        assert (r["slots"] == 0) == (r["taken"] == 0) == (r["first_slot"] is None)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= off for s in sizes), [(taken[s], goal[s]) for s in sizes]
    return sorted(tuple("" if x is None else str(x) for x in r) for r in rows)


def test_mixing(documents):
    texts = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
    one = check_mix(mixing.mix(documents).collect(), texts, off=8)  # a slot is a word here
    again = check_mix(mixing.mix(documents.repartition(7)).collect(), texts, off=8)
    assert one == again and len(one) == len(texts)


def test_mixing_awkward(spark):
    rows = [(1, None, "en", "b", 1), (2, "", "en", None, 0), (3, "a b c", "en", "a", 1), (3, "a b c", "en", "a", 1), (None, "no id at all", "fr", "c", 1), (5, "word " * 5000, "de", "c", 1), (6, "x" * 70000, "de", "é", 1), (7, "q", "de", "", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit(2)).withColumn("rank", F.lit(1)).withColumn("h", F.lit(1))
    check_mix(mixing.mix(df).collect(), [(r[0], r[1], r[3]) for r in rows], off=8)
    assert mixing.mix(df.limit(0)).count() == 0
    assert [(r["target"], r["taken"]) for r in mixing.mix(df.filter("doc_id < 3")).collect()] == [(0.0, 0)] * 2


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 100}, {"a": 0, "b": 5}, {str(i): i * i for i in range(60)}, {"": 1, "\U0001f600": 7, "\uff01": 9}])
def test_targets_stop_and_reshare(spark, sizes):
    stats = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(stats).collect()}
    want = slow_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 * (1 + want[s]) for s in want)


def test_many_sources_are_salted(documents, monkeypatch):
    one = sorted(map(str, mixing.mix(documents).collect()))
    monkeypatch.setattr(mixing, "BROADCAST", 3)
    assert sorted(map(str, mixing.mix(documents).collect())) == one


def test_every_run_of_slots_is_near_the_weights(spark):
    stats = spark.createDataFrame([("a", 600_000), ("b", 300_000), ("c", 100_000)], "source string, source_size long")
    arcs, slots = mixing.shares(mixing.targets(stats, weights=(1.0,)), 100)
    got = sorted((r["position"], r["source_no"]) for r in mixing.schedule(arcs, slots, 3).collect())
    whole = collections.Counter(s for _, s in got)
    seen = collections.Counter()
    for i, (_, s) in enumerate(got, 1):
        seen[s] += 1
        assert all(abs(seen[k] - whole[k] * i / len(got)) < 12 for k in whole)
