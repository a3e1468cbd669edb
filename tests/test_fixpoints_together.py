"""Fixpoints, subsets and Hall groups of many ciphers, and pairs of byte functions, against the plain forms."""

import random

import numpy as np

from tracewright.operators import bitrules, ciphers
from tracewright.operators import solve as ops


def drawn(n, seed=1):
    """Domains of one to ten letters, as sets and as masks by letter and puzzle."""
    rng, sets = random.Random(seed), []
    domain, there = np.zeros((10, n), np.int16), np.zeros((10, n), bool)
    for p in range(n):
        letters = rng.randrange(1, 11)
        start = rng.sample(range(10), letters)
        sets.append([({s} if rng.random() < 0.8 else set()) | {v for v in range(10) if rng.random() < rng.choice([0.05, 0.2, 0.5])} or {rng.randrange(10)} for s in start])
        for i, d in enumerate(sets[-1]):
            domain[i, p], there[i, p] = sum(1 << v for v in d), True
    return sets, domain, there


def test_subsets_and_matchings():
    sets, domain, there = drawn(ciphers.SOME + 100)
    assert ciphers.matchable(domain, there).tolist() == [ops.all_different(d) for d in sets]
    after = domain.copy()
    cuts = ciphers.subset_cuts(after, there)
    for p, d in enumerate(sets):
        plain = {chr(65 + i): set(s) for i, s in enumerate(d)}
        assert ops.subset_cuts(plain) == cuts[p] and [sum(1 << v for v in s) for s in plain.values()] == after[: len(d), p].tolist()


def test_hall_groups():
    sets, domain, there = drawn(ciphers.SOME + 50, 2)
    for p, (refuted, largest) in enumerate(zip(*ciphers.hall_groups(domain, there), strict=True)):
        groups = [ops.hall_violator([{v} if y == x else e - {v} for y, e in enumerate(sets[p])]) for x, d in enumerate(sets[p]) for v in sorted(d)]
        assert (refuted, largest) == (sum(g is not None for g in groups), max(len(g or ()) for g in groups))


def test_fixpoints():
    """Those of solve.Cipher, also of ciphers that say what can't be."""
    rng, made = random.Random(3), []
    for k in range(200):
        eqs = []
        for _ in range(rng.randrange(1, 5)):
            a, b = rng.randrange(10, 100), rng.randrange(10, 100)
            told = lambda x: "".join("ABCDEFGHIJ"[int(c)] for c in str(x))
            eqs.append((told(a), "+", told(b), told(a + b + (k % 7 == 0))))
        made.append(ops.Cipher(eqs, {"+": ["add"]}))
    start, after, alive = ciphers.fixpoints(made)
    for p, c in enumerate(made):
        domain = c.start()
        assert start[: len(domain), p].tolist() == [sum(1 << v for v in d) for d in domain.values()]
        assert c._propagate(domain, {"+": ["add"]}) == alive[p]
        if alive[p]:
            assert after[: len(domain), p].tolist() == [sum(1 << v for v in d) for d in domain.values()]
    assert alive.any() and not alive.all()


def test_compositions():
    rng, tables, xs, ys = random.Random(4), list(bitrules.library().values()), [], []
    for i in range(60):
        x = [rng.randrange(256) for _ in range(i % 7)]
        a, b = rng.choice(tables), rng.choice(tables)
        xs.append(x)
        ys.append([b[a[v]] for v in x] if i % 3 else [rng.randrange(256) for _ in x])
    assert bitrules.compositions(xs, ys) == [bitrules.composition(x, y) for x, y in zip(xs, ys, strict=True)]
