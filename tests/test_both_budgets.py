"""Both budgets of K26 are one search."""

import random

from tracewright.operators import ciphers
from tracewright.operators.solve import Cipher


def some_ciphers(budget: int) -> list[Cipher]:
    rng, out = random.Random(2), []
    letters = str.maketrans("0123456789", "ABCDEFGHIJ")
    for _ in range(60):
        eqs = []
        for _ in range(rng.randrange(1, 5)):
            a, b = rng.randrange(10, 100), rng.randrange(10, 100)
            eqs.append((str(a).translate(letters), "+", str(b).translate(letters), str(a + b + (rng.random() < 0.1)).translate(letters)))
        out.append(Cipher(eqs, {"+": ["add"]}, budget=budget))
    return out


def test_both_budgets_in_one_search(monkeypatch):
    for short in (1, 5, 20, 60):
        want = [(c.nodes, bool(c.found)) for c in ciphers.solve_all(some_ciphers(short), 1)]
        full = [(c.nodes, c.found) for c in ciphers.solve_all(some_ciphers(5000), 1)]
        alone = some_ciphers(short)
        for c in alone:
            c.solve(1)
        assert want == [(c.nodes, bool(c.found)) for c in alone]
        calls, plain = [], ciphers._solve
        monkeypatch.setattr(ciphers, "_solve", lambda *a: calls.append(1) or plain(*a))  # noqa: B023
        cs = some_ciphers(5000)
        assert ciphers.solve_under_both(cs, short) == want and [(c.nodes, c.found) for c in cs] == full and calls == [1]
        monkeypatch.setattr(ciphers, "_solve", plain)
