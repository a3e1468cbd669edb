"""The SimHash join deals fingerprints out before it makes cells of them, and counts only cells that could be large."""

import random

from tracewright.llm import simhash


def few_files(spark, fps):
    return spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in fps], "fp long").coalesce(1)


def caught(monkeypatch):
    seen, plain = {}, simhash.cut

    def cut(df, name):
        seen[name] = df
        return plain(df, name)

    monkeypatch.setattr(simhash, "cut", cut)
    return seen


def test_cells_are_made_in_many_tasks(spark):
    """Of a table in one file cells aren't made in one task."""
    rng = random.Random(3)
    plan = simhash.links(few_files(spark, [rng.getrandbits(64) for _ in range(50)]))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [fp" in plan[plan.index("Generate") :]


def test_only_cells_that_could_be_large_are_counted(spark, monkeypatch):
    """Vectors that differ leave no cell to count; those that are alike in all but one group leave all theirs."""
    rng, seen = random.Random(4), caught(monkeypatch)
    simhash.links(few_files(spark, [rng.getrandbits(64) for _ in range(60)]), 4, 60)
    assert seen["large"].count() == 0 and "array_compact" in seen["large"]._jdf.queryExecution().analyzed().toString()
    near = sorted({1 << a | 1 << b for a in range(8) for b in range(8)})
    edges = {tuple(r) for r in simhash.links(few_files(spark, near), 4, 20).collect()}
    large = seen["large"].collect()
    # the lowest group differs, so the 35 grids without it have one cell of all; the others' cells are small or large by that byte
    assert len(large) >= 35 and max(r["chunks"] for r in large) == -(-len(near) // 20)
    root = {p: p for p in near}
    for _ in near:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert set(root.values()) == {near[0]}
