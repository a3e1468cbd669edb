"""Checks of stored puzzles and traces that know nothing of the solver: they read what a trace says and work it out again."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EXAMPLE = re.compile(r"^\s*(\d+)(\D)(\d+)\s*=\s*(\S+)\s*$", re.M)
ASKED = re.compile(r"determine the result for:\s*(\d+)(\D)(\d+)")
DENOTED = re.compile(r"^\s*(\S)\s*->\s*([a-z])\s*$", re.M)
SUMMARY = re.compile(r"^Summary:.*Confirm reading order = (\w+), (.*)$", re.M)
SAID = re.compile(r"^(-?)(\|?)([ab])([-+×∥])([ab])\|?([-+]\d)?$")


def _work_out(form: str, a: str, b: str) -> str | None:
    """What a form such as -|a-b| or b-a+1 gives; None for what isn't one."""
    m = SAID.match(form)
    if m is None:
        return None
    x, y = ({"a": a, "b": b}[m[i]] for i in (3, 5))
    if m[4] == "∥":
        return x + y
    x, y = int(x), int(y)
    v = {"+": x + y, "-": x - y, "×": x * y}[m[4]]
    v = abs(v) if m[2] else v
    return str((-v if m[1] else v) + int(m[6] or 0))


def _unsigned(s: str) -> str:
    """A sign of any kind at either end as a minus in front."""
    return re.sub(r"^\D(\d+)$|^(\d+)\D$", lambda m: "-" + (m[1] or m[2]), s)


def _mirrored(s: str) -> str:
    return re.sub(r"\d+", lambda m: m[0][::-1], s)


def verify_trace(prompt: str, gold: str, trace: str) -> str:
    """PASS, EX_FAIL (an example isn't what the trace's operators give), GOLD_FAIL (the answer isn't), or noparse."""
    letters = dict(DENOTED.findall(trace or ""))
    summary = SUMMARY.search(trace or "")
    asked, examples = ASKED.search(prompt or ""), EXAMPLE.findall(prompt or "")
    if not letters or summary is None or asked is None or not examples:
        return "noparse"
    forms = dict(part.split(" = ", 1) for part in summary[2].split(", ") if " = " in part)
    read = _mirrored if summary[1] == "leftward" else str

    def holds(a: str, op: str, b: str, out: str) -> bool | None:
        got = _work_out(forms.get(letters.get(op, ""), ""), read(a), read(b))
        return None if got is None else got == read(_unsigned(out))

    for a, op, b, out in examples:
        # operators that the trace leaves open explain nothing and claim nothing
        if holds(a, op, b, out) is False:
            return "EX_FAIL"
    right = holds(*asked.groups(), gold)
    return "noparse" if right is None else "PASS" if right else "GOLD_FAIL"


def violations(prompt: Column, gold: Column, box: Column, label: Column, kind: Column) -> Column:
    """The hard rules that a puzzle breaks: signs are the operator's own, a negative answer has a signed example, the box isn't empty, ambiguous puzzles are."""
    part = lambda i: F.regexp_extract_all(prompt, F.lit(r"(?m)^\s*(\d+)(\D)(\d+)\s*=\s*(\S+)\s*$"), F.lit(i))
    lines = F.zip_with(part(2), part(4), lambda op, out: F.struct(op.alias("op"), F.regexp_replace(out, r"\d", "").alias("sign")))
    signed = F.filter(lines, lambda e: e["sign"] != "")
    asked, sign = F.regexp_extract(prompt, r"determine the result for:\s*\d+(\D)\d+", 1), F.regexp_replace(gold, r"\d", "")
    rules = [
        (F.exists(signed, lambda e: e["sign"] != e["op"]), "example signed by another operator"), (F.exists(signed, lambda e: (e["sign"] == "-") & (e["op"] != "-")), "example with a minus for a glyph"),
        ((sign != "") & (F.size(signed) == 0), "negative answer without a negative example"), ((sign != "") & (sign != asked), "answer signed by another operator"), ((sign == "-") & (asked != "-"), "answer with a minus for a glyph"),
        (F.coalesce(box, F.lit("")).isin("", "NOT_FOUND"), "no box"), ((kind == "ambiguous") & (label != "ambiguous_arithmetic"), "ambiguous puzzle of another label"),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in rules)))
