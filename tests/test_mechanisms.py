"""Trees, phrase tables, learned merges and scored predictors against plain loops."""

import collections
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import merge, merges, phrases, report, trees


def slow_walk(text):
    """(path, depth, kind, value) of every node."""
    out = []

    def go(path, depth, x):
        kind = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}[type(x)]
        out.append((path, depth, kind, json.loads(json.dumps(x, sort_keys=True))))
        if isinstance(x, dict):
            for k, v in x.items():
                quoted = k if re.fullmatch("[A-Za-z0-9_]+", k) else '"' + k.replace("\\", "\\\\").replace('"', '\\"') + '"'
                go(f"{path}.{quoted}", depth + 1, v)
        if isinstance(x, list):
            for i, v in enumerate(x):
                go(f"{path}[{i}]", depth + 1, v)

    go("$", 0, json.loads(text))
    return out


def some_tree(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([None, True, False, 7, -3, 2.5, "s", 'q"uo\\te', "é", [], {}])
    if rng.random() < 0.5:
        return [some_tree(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b_1", "two words", 'c"d', "e.f", "g\\h"]) + str(i): some_tree(rng, depth - 1) for i in range(rng.randrange(4))}


def test_walk_of_random_trees(spark):
    rng = random.Random(13)
    docs = [(i, json.dumps(some_tree(rng, 5))) for i in range(60)] + [(100, None)]
    got = collections.defaultdict(list)
    for r in trees.walk(spark.createDataFrame(docs, "id long, doc string"), "id", "doc").collect():
        got[r["id"]].append((r["path"], r["depth"], r["kind"], json.loads(r["value"])))
    key = lambda x: x[0]
    assert {i: sorted(v, key=key) for i, v in got.items()} == {i: sorted(slow_walk(t), key=key) for i, t in docs if t}


def test_deep_trees_and_limits(spark):
    deep = spark.createDataFrame([(1, '{"a":' * 200 + "[1]" + "}" * 200)], "id long, doc string")
    last = trees.leaves(trees.walk(deep, "id", "doc")).collect()
    assert [(r["depth"], r["path"]) for r in last] == [(201, "$" + ".a" * 200 + "[0]")]
    with pytest.raises(Exception, match="(?i)recursion"):
        trees.walk(deep, "id", "doc", levels=20)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") != "-1"


def test_text_that_isnt_json(spark):
    docs = spark.createDataFrame([(1, "{not"), (2, "[1]"), (3, None)], "id long, doc string")
    assert {r["id"] for r in trees.walk(docs, "id", "doc", lenient=True).collect()} == {2}
    with pytest.raises(Exception, match="MALFORMED"):
        trees.walk(docs, "id", "doc")
    assert trees.walk(docs.limit(0), "id", "doc").count() == 0


def test_compare(spark):
    side = lambda rows: trees.walk(spark.createDataFrame(rows, "id long, doc string"), "id", "doc")
    left, right = side([(1, '{"a":1,"b":[1,2],"c":{}}'), (2, "1")]), side([(1, '{"a":"1","b":[1],"c":{"d":null}}'), (3, "1")])
    got = {(r["id"], r["path"], r["left"], r["right"], r["what"]) for r in trees.compare(left, right, "id").collect()}
    assert got == {(1, "$.a", "1", '"1"', "changed"), (1, "$.b[1]", "2", None, "removed"), (1, "$.c", "{}", None, "removed"), (1, "$.c.d", None, "null", "added"), (2, "$", "1", None, "removed"), (3, "$", None, "1", "added")}


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_phrases_against_a_loop(spark, monkeypatch, broadcast):
    monkeypatch.setattr(phrases, "BROADCAST", broadcast)
    rng = random.Random(broadcast)
    text = lambda n: "".join(rng.choice(["a", "b", "b", "b", "c", "É", "7"]) + rng.choice([" ", ", ", "\n"]) for _ in range(rng.randrange(n)))
    docs = [(i, text(60)) for i in range(50)] + [(90, None), (91, ""), (92, "b " * 400)]
    table = [(i, text(6)) for i in range(80)] + [(90, None), (91, "..."), (92, "unknown"), (93, "a unknown"), (94, "b b b"), (95, "B, b b!")]
    postings = phrases.index(spark.createDataFrame(docs, "d long, t string").repartition(3), "d", "t")
    got = {(r["phrase"], r["id"]): r["n"] for r in phrases.hits(spark.createDataFrame(table, "p long, t string"), postings, "p", "t").collect()}
    want = {}
    for p, t in table:
        for d, body in docs:
            x, y = words(t), words(body)
            n = sum(y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1)) if x else 0
            if n:
                want[p, d] = n
    assert got == want


def test_totals_have_zeros_and_an_index_may_be_of_some_words(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "two three two three")], "d long, t string")
    found = spark.createDataFrame([("two three",), ("three one",), ("",)], "p string")
    postings = phrases.index(docs, "d", "t", spark.createDataFrame([("two",), ("three",)], "token string"))
    assert {tuple(r) for r in phrases.totals(found, postings, "p", "p").collect()} == {("two three", 2, 3), ("three one", 0, 0), ("", 0, 0)}
    assert phrases.totals(found, phrases.index(docs.limit(0), "d", "t"), "p", "p").count() == 3


def slow_merges(counted, most, least=2):
    """One merge after the other over all words."""
    held = {w: [f"{b:02X}" for b in w.encode()] for w in counted}
    out = []
    for rank in range(most):
        n = collections.Counter()
        for w, s in held.items():
            for p in zip(s, s[1:], strict=False):
                n[p] += counted[w]
        if not n or max(n.values()) < least:
            break
        a, b = min(n, key=lambda p: (-n[p], p))
        out.append((rank, a, b, n[a, b]))
        for w, s in held.items():
            t, i = [], 0
            while i < len(s):
                hit = s[i : i + 2] == [a, b]
                t.append(a + b if hit else s[i])
                i += 2 if hit else 1
            held[w] = t
    return out, held


def test_merges_of_documents_equal_a_plain_loop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counted = merges.words(docs, "text")
    want, held = slow_merges({r["word"]: r["n"] for r in counted.collect()}, 60)
    found = merges.learn(counted, 60)
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) == 60
    text = lambda h: bytes.fromhex(h).decode("utf-8", "replace")
    for r in merges.segmented(counted, "word", found).limit(2000).collect():
        assert r["symbols"] == [f"\\x{h}" if "\ufffd" in text(h) else text(h) for h in held[r["word"]]]


def test_merges_of_awkward_words(spark, monkeypatch):
    monkeypatch.setattr(merges, "WRITE", 3)
    texts = [("aaaa aaa aa a <a> > < \x01 é éé ééé",), (None,), ("",), ("aaaaaaa <><> ab abab ababab b",), ("x",)]
    counted = merges.words(spark.createDataFrame(texts, "t string"), "t")
    want, _ = slow_merges({r["word"]: r["n"] for r in counted.collect()}, 50)
    assert sorted(tuple(r) for r in merges.learn(counted, 50).collect()) == want
    assert merges.learn(counted.limit(0), 5).count() == 0
    assert merges.dictionary(counted, merges.learn(counted, 0)).count() == 0


def test_tree_of_decompositions_equals_one(spark, monkeypatch):
    monkeypatch.setattr(merge, "BLOCK", 7)
    monkeypatch.setattr(merge, "FAN_IN", 2)
    rng = np.random.default_rng(5)
    for low in (12, 3):  # full and reduced rank
        left, right = rng.normal(size=(300, low)) @ rng.normal(size=(low, 12)), rng.normal(size=(300, 10))
        right = np.hstack([right, rng.normal(size=(300, 2))])
        rows = [(0 if i % 3 else 1, i % 4, i, [float(x) for x in (*left[i], *right[i])]) for i in range(300)]
        df = spark.createDataFrame(rows, "module long, step int, k int, embedding array<double>").repartition(9)
        weights = {0: 1.0, 1: -0.5, 2: 2.0, 3: 1.5}
        got = merge.svd_merge(df, 12, weights).collect()
        for module in (0, 1):
            mine = [i for i in range(300) if (0 if i % 3 else 1) == module]
            w = np.array([weights[i % 4] for i in mine])
            total = sum(weights[s] for s in {i % 4 for i in mine})
            want = np.linalg.svd((left[mine] * w[:, None]).T @ right[mine] / total, compute_uv=False)
            found = sorted((r["k"], r["singular"], r["b_norm"], r["a_norm"]) for r in got if r["module"] == module)
            assert np.allclose([r[1] for r in found], want, rtol=1e-9, atol=1e-9 * want[0])
            assert np.allclose([r[2] ** 2 for r in found], want, rtol=1e-8, atol=1e-8 * want[0]) and np.allclose([r[3] ** 2 for r in found], want, rtol=1e-8, atol=1e-8 * want[0])
    assert merge.svd_merge(df.limit(0), 3).count() == 0


def test_scores_of_rows_left_out(spark):
    rng = random.Random(36)
    rows = [(rng.choice("xyz"), rng.randrange(9), rng.choice(["a", "b", "c", None])) for _ in range(120)] + [("alone", 99, "a"), (None, 98, "b"), (None, 98, "b")]
    df = spark.createDataFrame(rows, "s string, k int, v string")
    got = {r["predictor"]: (r["rows"], r["told"], r["hits"], r["rank"]) for r in report.leave_one_out(df, "v", {"all": [], "s": ["s"], "both": ["s", "k"]}).collect()}
    want = {}
    for name, group in {"all": lambda r: 0, "s": lambda r: r[0], "both": lambda r: r[:2]}.items():
        mine = [r for r in rows if r[2] is not None]
        told = hits = 0
        for i, r in enumerate(mine):
            n = collections.Counter(x[2] for j, x in enumerate(mine) if j != i and group(x) == group(r))
            if n:
                told += 1
                hits += min(n, key=lambda v: (-n[v], v)) == r[2]
        want[name] = (len(mine), told, hits)
    order = sorted(want, key=lambda p: (-want[p][2], p))
    assert got == {p: (*want[p], order.index(p) + 1) for p in want}
    assert [tuple(r)[1:4] for r in report.leave_one_out(df.limit(0), "v", {"all": []}).collect()] == [(0, 0, 0)]
