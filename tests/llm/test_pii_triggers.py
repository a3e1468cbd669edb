"""Disguised addresses are found whatever else the text holds."""

import random
import time

import pytest

from tracewright.llm import pii


@pytest.mark.parametrize("shown", ["jane {at} host.org", "jane <at> host.org", "jane [ at ] host.org", "jane ( at ) host.org", "jane at host[.]org", "a.b.c.d.e.f.g [at] host.org", "x [at] a.b.c.d.e.f.g.h.i.org"])
def test_found_by_itself(shown):
    for text in (f"mail {shown}!", f"mail {shown}! A dot (at) home."):
        assert [text[a:b] for k, a, b in pii.find(text)[1] if k == "email"] == [shown]


@pytest.mark.parametrize("zero", ["০", "๐", "߀", "𝟎"])
def test_digits_of_every_script(zero):
    shown = "".join(chr(ord(zero) + int(c)) if c.isdigit() else c for c in "10.0.0.1")
    assert [shown] == [f"ip {shown}!"[a:b] for k, a, b in pii.find(f"ip {shown}!")[1] if k == "ip"]


def test_hints_are_a_superset():
    rng = random.Random(5)
    parts = ["jane", "x", " ", " ", "at", "AT", "dot", "Punkt", "arroba", "KLAMMERAFFE", "[", "]", "(", ")", "{", "}", "<", ">", "@", ".", "\n", "one", "Zwei", "TROIS", "fünf", "más", "plus", ",", "-", "_", "7", "é"]
    for _ in range(40000):
        t = "".join(rng.choice(parts) for _ in range(14))
        address, digits = pii.hints(t)
        r = pii.Rewriting(t)
        assert (address or pii.plain_addresses(r) is r) and (digits or pii.plain_digits(r) is r), t


def test_prose_after_at_is_no_host():
    for t in ("I met her at the dot com event", "see @ home. Then go", "She was at a point. Two or three.", "one two dot three four", "In 1999 one of 20 came, two left."):
        assert pii.find(t)[1] == []


@pytest.mark.parametrize(
    ("shown", "kind"),
    [("192 dot 168 dot 1 dot 1", "ip"), ("10.0 punkt 0 punkt 1", "ip"), ("+1 two three 4 five six 7 8 nine", "phone"), ("4111 1111 one one one one 1111", "card"), ("j a n e @ host . org", "email"), ("jane @ mail . host . org", "email"), ("jane.doe @ host dot org", "email")],
)
def test_mixed_disguises(shown, kind):
    assert [shown] == [f"so: {shown}; ok"[a:b] for k, a, b in pii.find(f"so: {shown}; ok")[1] if k == kind]


UNITS = ["a dot ", "at ", "a at ", "x at a dot ", "@ ", " @", "[at] ", "a [dot] ", "one ", "1 one ", "dot ", "at dot ", "( ", "a.b.", "a . ", "[ at", " ", "plus one ", "a b c ", "x@y dot ", "-", "a-", "1.", "at at dot "]


@pytest.mark.parametrize("unit", UNITS)
def test_time_is_in_proportion_to_length(unit):
    """Eight times the text takes no more than some sixteen times as long; the square would be sixty-four."""
    def took(n):
        text, best = unit * (n // len(unit)), float("inf")
        for _ in range(3):
            began = time.perf_counter()
            pii.find(text)
            best = min(best, time.perf_counter() - began)
        return best

    assert took(160_000) < 16 * took(20_000) + 0.05
