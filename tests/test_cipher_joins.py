"""Solutions counted by joins, against the search."""

from test_ciphers_together import drawn

from tracewright.operators import cipherjoins, ciphers, solve
from tracewright.plans import puzzles


def one_variant() -> list[tuple]:
    made = [(e, {f: vs[:1] for f, vs in families.items()}) for e, families, little in drawn(400, 7) if not little]
    made += [([("A", "?", "A", zero)], {"?": ["sub_signed"]}) for zero in ("B", "-B", "A", "-A")]
    return [c for c in made if cipherjoins.has_room(*c)]


def test_counts_are_those_of_the_search(monkeypatch):
    some = one_variant()
    for most in (1, 2, 5):
        want = [len(c.found) for c in ciphers.solve_all([solve.Cipher(e, f, budget=10**7) for e, f in some], most)]
        assert cipherjoins.solution_counts(some, most, step=50).tolist() == want and set(want) >= {0, most}
    monkeypatch.setattr(cipherjoins, "ROWS", 5)
    assert cipherjoins.solution_counts(some[:40]).tolist() == [min(2, len(c.found)) for c in ciphers.solve_all([solve.Cipher(e, f, budget=10**7) for e, f in some[:40]])]


def test_what_has_no_room_is_told():
    assert not cipherjoins.has_room([("ABC", "?", "D", "ABE")], {"?": ["add"]})
    assert not cipherjoins.has_room([("AB", "?", "D", "AE")], {"?": ["add", "mul"]})
    assert not cipherjoins.has_room([("AB", "?", "CD", "EF"), ("GH", "?", "IJ", "KA")], {"?": ["add"]})
    assert cipherjoins.solution_counts([]).tolist() == []


def test_classes_need_no_search(spark, monkeypatch):
    """The query's ciphers have room, so none is searched."""
    for e in ([("AB", "+", "CD", "EF")], [("AB", "#", "CD", "-E")], [("JJ", "*", "JJ", "JIAB")]):
        assert cipherjoins.has_room(e, {op: puzzles.SIGN_FAMILIES[op] for _, op, _, _ in e})
    monkeypatch.setattr(puzzles, "cipher_of", None)
    got = {r["class"]: r["n"] for r in puzzles.solution_classes(spark, "/root/testdata/sf0.001").collect()}
    assert sum(got.values()) == puzzles.ciphers(spark, "/root/testdata/sf0.001").count() and set(got) <= {"unique", "multi", "concat"}
