"""Training examples: a public tokenizer, padding, pairs and corrections against plain loops."""

import random

from pyspark.sql import functions as F

from tracewright.functions import tokens
from tracewright.operators import bitrules, trainset
from tracewright.plans import registry

SF = "/root/testdata/sf0.001"


def test_token_ids_of_whole_texts(spark):
    from tokenizers import Tokenizer

    registry.load()
    tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    ids = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.QUERIES["T3_tokenise"](spark, SF).collect()
    assert {r["id"] for r in rows} == set(docs)
    for r in rows:
        d = docs[r["id"]]
        p, c = ids(f"Write for {d['source']}"), ids(d["text"])
        assert (r["n_prompt"], r["n_completion"], r["ids"]) == (len(p), len(c), (p + c + [1])[:512])


def test_padding(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randrange(9) for _ in range(rng.randrange(6))]) for i in range(23)]
    df = spark.createDataFrame(rows, "n long, ids array<int>")
    for r in trainset.micro_batches(df, "n", "ids", 5, fill=7).collect():
        mates = [x for n, x in rows if n // 5 == r["n"] // 5]
        width = max(map(len, mates))
        assert r["width"] == width and r["padded"]["ids"] == r["ids"] + [7] * (width - len(r["ids"])) and r["padded"]["mask"] == [1] * len(r["ids"]) + [0] * (width - len(r["ids"]))


def test_preference_sides(spark):
    rows = [([1, 2], [3, 4], True), ([1, 2], [3, 4], False), ([1] * 9, [3], True), ([], [], False), ([1], [], True)]
    df = spark.createDataFrame(rows, "p array<int>, a array<int>, e boolean")
    for r in df.select("*", trainset.preference_side(F.col("p"), F.col("a"), F.col("e"), 99, 6).alias("s")).collect():
        whole = (r["p"] + r["a"] + [99] * r["e"])[:6]
        assert r["s"]["ids"] == whole and r["s"]["mask"] == [int(i >= len(r["p"])) for i in range(len(whole))]


def test_corrections_are_true():
    rng, seen = random.Random(3), set()
    for _ in range(120):
        xs = [rng.randrange(256) for _ in range(rng.choice([3, 7]))]
        ys = [rng.randrange(256) for _ in xs] if rng.random() < 0.3 else [(x << 3 | x >> 5) & 255 for x in xs]
        limit = rng.choice([9, 25, 45, 80])
        reason, n, text = bitrules.correction(xs, ys, limit)
        seen.add(reason)
        if text is None:
            assert n == 0 and reason in ("nothing to correct", "too long")
            continue
        lines = text.split("\n")[1:]
        assert reason == f"top {n}" and len(lines) == n and len(text.split()) <= limit
        for line in lines:
            i, bad, got, k, good = int(line.split()[1][:-1]), line.split()[2], int(line.split()[4]), int(line.split("EX")[1].split()[0]), line.split("; ")[1].split()[0]
            form = {label: f for _, label, f in bitrules.bit_labels(False)}
            bit = lambda label, x: bitrules.bit_value(form[label], bitrules.example_planes([x]), 1)  # noqa: B023, E731
            assert bit(bad, xs[k - 1]) == got != ys[k - 1] >> (7 - i) & 1 and all(bit(good, x) == y >> (7 - i) & 1 for x, y in zip(xs, ys, strict=True))
    assert {"top 1", "top 2", "top 3", "too long"} <= seen
