"""Ciphers of one variant are searched apart from others; what is found and the nodes stay those of each."""

from tracewright.operators import ciphers
from tracewright.operators.solve import Cipher

FAMILIES = {"*": ["mul"], "+": ["add"], "-": ["absdiff"], "$": ["mul_p1"], "#": ["sub_signed"], "&": ["add_m1"]}
RESULT = {"*": lambda a, b: a * b, "+": lambda a, b: a + b, "-": lambda a, b: abs(a - b), "$": lambda a, b: a * b + 1, "#": lambda a, b: a - b, "&": lambda a, b: a + b - 1}


def drawn(n):
    letters = str.maketrans("0123456789", "ABCDEFGHIJ")
    found = []
    for k in range(n):
        op = "*+-$#&"[k % 6]
        rows = [(a, b, RESULT[op](a, b)) for i in range(1 + k % 4) for a, b in [(10 + (k * 37 + i * 53) % 90, 10 + (k * 71 + i * 29) % 90)]]
        found.append(Cipher([(str(a).translate(letters), op, str(b).translate(letters), str(o).translate(letters)) for a, b, o in rows], {op: FAMILIES[op]}, budget=400))
    return found


def test_groups_are_of_one_variant_and_change_nothing(monkeypatch):
    made = drawn(180)
    groups = ciphers._alike(made, 20, least=10)
    assert sorted(k for g in groups for k in g) == list(range(180)) and all(len({str(made[k].families) for k in g}) == 1 and len(g) <= 20 for g in groups)
    alike = ciphers._alike
    monkeypatch.setattr(ciphers, "_alike", lambda some, step: alike(some, step, least=10))
    alone = drawn(180)
    for c in alone:
        c.solve(2)
    want = [(c.nodes, c.found) for c in alone]
    assert [(c.nodes, c.found) for c in ciphers.solve_all(made)] == want
    both = drawn(180)
    ciphers.solve_under_both(both, 20, most=2)
    assert [(c.nodes, c.found) for c in both] == want
