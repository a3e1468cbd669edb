"""Ciphers searched in step, against the search of each alone."""

import random

from tracewright.operators import ciphers, numeric, puzzles, solve, symbols


def drawn(n: int, seed: int = 4) -> list[tuple]:
    rng, made = random.Random(seed), []
    told = lambda x: ("-" if x < 0 else "") + str(abs(x)).translate(str.maketrans("0123456789", "ABCDEFGHIJ"))
    for _ in range(n):
        families = rng.sample(list(numeric.VARIANTS), rng.choice([1, 1, 2]))
        fits = {f: rng.choice(numeric.VARIANTS[f]) for f in families}
        e = [(told(a), f, told(b), told(solve.number(fits[f], a, b) + (rng.random() < 0.05))) for f in families for a, b in [(rng.randrange(1, 100), rng.randrange(1, 100)) for _ in range(rng.randrange(1, 6))]]
        made.append((e, {f: (numeric.VARIANTS[f] if rng.random() < 0.5 else [fits[f]]) for f in families}, rng.random() < 0.3))
    return made


def test_solutions_and_nodes_are_those_of_each_alone():
    for most, budget in ((2, 3000), (1, 20), (3, 1), (2, 0)):
        pairs = [tuple(solve.Cipher(e, f, little, budget) for _ in range(2)) for e, f, little in drawn(60)]
        pairs += [tuple(solve.Cipher(e, {"?": ["add"]}, False, budget) for _ in range(2)) for e in ([("ABCDE", "?", "B", "ABCDF")], [("AB", "?", "CD", "EFGHIJK")], [])]
        ciphers.solve_all([b for _, b in pairs], most, step=25, pool=7)
        for a, b in pairs:
            a.solve(most)
            assert (a.nodes, a.found) == (b.nodes, b.found)


def test_symbol_puzzles_together_are_those_of_each():
    texts = [p["prompt"] for i in range(25) if (p := puzzles.construct(i, "symbol"))] + ["nothing"]
    parsed = [symbols.parse(t) for t in texts[:-1]]
    for little, budget in ((False, symbols.BUDGET), (True, 30)):
        assert symbols.assign_all(parsed, little, budget) == [symbols.assign(p, little, budget) for p in parsed]
    assert symbols.solve_prompts(texts) == [symbols.solve(t) for t in texts]
