"""Three limits at once: conversations by tokens, segments and loss-bearing tokens."""

import collections

import numpy as np
import pytest

from tracewright.llm import packing

SF = "/root/testdata/sf0.001"


def check(rows, capacity):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append(r)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity[0] and len(b) <= capacity[1] and sum(r["loss"] for r in b) <= capacity[2]
    return len(bins)


@pytest.mark.parametrize("capacity", [(2048, 256, 2048), (2048, 4, 600), (4096, 3, 150)])
def test_conversations(spark, capacity):
    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(packing.tokenizer_path()), collections.defaultdict(lambda: [0, 0, 0])
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    for r in turns.collect():
        n = len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        want[r["conv_id"]][0] += n
        want[r["conv_id"]][1] += n * (r["role"] == "assistant")
        want[r["conv_id"]][2] += 1
    placed, left = (df.collect() for df in packing.pack_instructions(turns, capacity=capacity))
    assert {r["d"]: [r["length"], r["loss"], r["turns"]] for r in [*placed, *left]} == want
    assert all(r["length"] > capacity[0] or r["loss"] > capacity[2] for r in left)
    least = max(sum(r["length"] for r in placed) / capacity[0], len(placed) / capacity[1], sum(r["loss"] for r in placed) / capacity[2])
    assert check(placed, capacity) <= 1.35 * least + 2


def test_the_loss_limit_decides(spark):
    """Two thirds of the rows are all loss: by tokens and segments alone their sequences would overflow."""
    rng = np.random.default_rng(3)
    rows = [(i, int(n), int(n) if i % 3 else 0, i) for i, n in enumerate(rng.integers(1, 500, 3000))]
    df = spark.createDataFrame(rows, "d long, length long, loss long, slot long")
    capacity = (2048, 64, 1024)
    got = packing.place(df, capacity, group=1000).collect()
    assert sorted(r["d"] for r in got) == list(range(3000))
    bins = check(got, capacity)
    assert bins <= 1.1 * max(sum(r[1] for r in rows) / 2048, sum(r[2] for r in rows) / 1024) + 3
    plain = packing.place(df.drop("loss"), capacity, group=1000).collect()
    loss = collections.Counter()
    for r in plain:
        loss[r["sequence_id"]] += rows[r["d"]][2]
    assert max(loss.values()) <= 1024 and len(loss) > bins


def test_memory_of_chunks_is_bounded_by_bytes(monkeypatch):
    packing.loaded().clear()
    monkeypatch.setattr(packing, "REMEMBERED", 100_000)
    chunks = packing.ChunkTokenizer(packing.tokenizer_path())
    texts = [" ".join(f"w{'abcdefghij'[k % 10]}{chr(97 + k // 260)}{chr(97 + k % 26)}" for k in range(i, i + 50)) for i in range(3000)] + [b"x".decode() * 60_000]
    size = lambda: sum(len(k) + len(v) + packing.ENTRY for r in (chunks.seen, chunks.words) for d in (r.young, r.old) for k, v in d.items())
    turned = 0
    for _ in chunks.ids([t.encode() for t in texts]):
        assert size() <= 100_000 + 2 * 400_000  # the long chunk's ids stand in both
        turned += bool(chunks.seen.old)
    for _ in chunks.ids([b"a b", b"c"] * 2000):
        pass
    assert size() <= 100_000 + 400_000 and turned > 100
    assert packing.ChunkTokenizer(packing.tokenizer_path()).tokenizer is chunks.tokenizer
    packing.loaded().clear()
