"""Merges over blocks of words, against a loop over strings of symbols."""

import random
from collections import Counter

import numpy as np

from tracewright.operators import merges


def by_loop(words: dict[str, int], most: int) -> list[tuple]:
    state = {tuple(f"{b:02X}" for b in w.encode()): n for w, n in words.items()}
    found = []
    while len(found) < most:
        count = Counter()
        for w, n in state.items():
            for p in zip(w, w[1:]):
                count[p] += n
        left = [p for p in count if count[p] >= 2]
        if not left:
            break
        a, b = pair = min(left, key=lambda p: (-count[p], p))
        found.append((len(found), a, b, count[pair]))
        after = Counter()
        for w, n in state.items():
            made, i = [], 0
            while i < len(w):
                both = w[i : i + 2] == pair
                made.append(a + b if both else w[i])
                i += 2 if both else 1
            after[tuple(made)] += n
        state = after
    return found


def test_runs_and_symbols_of_two_merges(spark, monkeypatch):
    rng = random.Random(5)
    # few letters: runs, and symbols that are made in more than one way
    words = {"".join(rng.choice("aab") for _ in range(rng.randrange(1, 14))): rng.randrange(1, 9) for _ in range(150)} | {"éé": 3, "": 4}
    rows = spark.createDataFrame([*words.items(), (None, 7)], "word string, n long").repartition(3)
    monkeypatch.setattr(merges, "WRITE", 5)
    assert sorted(map(tuple, merges.learn(rows, 40).collect())) == by_loop(words, 40)


def test_a_round_reads_blocks_not_words(spark):
    """Words are one row for each batch, whatever their number."""
    rows = spark.createDataFrame([(f"w{i}".encode(), i) for i in range(900)], "word binary, n long").coalesce(1)
    assert rows.mapInArrow(merges._blocks, merges.BLOCK).count() == 1


def test_a_run_is_merged_from_the_left():
    flat = np.array([5, 5, 5, -1, 5, 5, 5, 5, -1, 5, -1], np.int32)
    uses = np.repeat([2, 3, 4], [4, 5, 2])
    made, kept, at, now = merges._merge(flat, uses, 5, 5, 9)
    assert made.tolist() == [9, 5, -1, 9, 9, -1, 5, -1] and kept.tolist() == [2, 2, 2, 3, 3, 3, 4, 4]
    assert flat[at].tolist() == [5, 5, 5] and made[now].tolist() == [9, 9, 9]
