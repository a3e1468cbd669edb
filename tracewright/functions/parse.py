"""Prompts to features, as Column expressions with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.text import strip


def parse_prompt(prompt: Column) -> tuple[Column, Column]:
    """(examples: array of (input, output), question): lines with `=`, and what follows `:` in the line that asks."""
    lines = F.transform(F.split(prompt, r"\R", -1), strip)
    asks = lambda s: F.startswith(F.lower(s), F.lit("now, determine the result for"))
    examples = F.transform(
        F.filter(lines, lambda s: F.contains(s, F.lit("=")) & ~asks(s)),
        lambda s: F.struct(strip(F.split(s, "=", 2)[0]).alias("input"), strip(F.split(s, "=", 2)[1]).alias("output")),
    )
    question = F.try_element_at(F.filter(lines, asks), F.lit(-1))
    return examples, F.when(F.contains(question, F.lit(":")), strip(F.try_element_at(F.split(question, ":", 2), F.lit(2))))


EQUATION = r"^([0-9]+)([^0-9])([0-9]+)$"


def parse_equation(text: Column) -> Column:
    """Struct (a, op, b), null where the text isn't two numbers around one sign."""
    part = lambda i: F.regexp_extract(text, EQUATION, i)
    return F.when(text.rlike(EQUATION), F.struct(part(1).alias("a"), part(2).alias("op"), part(3).alias("b")))


def output_norm(out: Column) -> Column:
    """A sign at either end becomes a leading minus."""
    s = strip(out)
    return F.when((s == "") | F.startswith(s, F.lit("-")), s).when(~s.rlike("^[0-9]"), F.concat(F.lit("-"), F.substring(s, F.lit(2), F.length(s)))).when(~s.rlike("[0-9]$"), F.concat(F.lit("-"), F.substring(s, F.lit(1), F.length(s) - 1))).otherwise(s)


def sign_in_place(out: Column) -> Column:
    s = strip(out)
    return F.when(s == "", s).when(~s.rlike("^[0-9]"), F.concat(F.lit("-"), F.substring(s, F.lit(2), F.length(s)))).when(~s.rlike("[0-9]$"), F.concat(F.substring(s, F.lit(1), F.length(s) - 1), F.lit("-"))).otherwise(s)


def reverse_digits(text: Column) -> Column:
    """The digits in reverse, a leading minus kept in front."""
    return F.when(F.startswith(text, F.lit("-")), F.concat(F.lit("-"), F.reverse(F.substring(text, F.lit(2), F.length(text))))).otherwise(F.reverse(text))


def target_of(out: Column, leftward: Column) -> Column:
    return F.when(leftward, reverse_digits(output_norm(out))).otherwise(output_norm(out))


def sign_format(outputs: Column) -> Column:
    """Struct (kind, glyph) of the first output that shows a sign; kind none without one."""
    kind = lambda s: F.when(F.startswith(s, F.lit("-")), "minus").when(~s.rlike("^[0-9]"), "prefix").when(~s.rlike("[0-9]$"), "suffix")
    signed = F.filter(F.transform(outputs, strip), lambda s: (s != "") & kind(s).isNotNull())
    first = F.try_element_at(signed, F.lit(1))
    glyph = F.when(kind(first) == "minus", "-").when(kind(first) == "prefix", F.substring(first, 1, 1)).when(kind(first) == "suffix", F.substring(first, -1, 1))
    return F.struct(F.coalesce(kind(first), F.lit("none")).alias("kind"), F.coalesce(glyph, F.lit("")).alias("glyph"))


def render_answer(value: Column, kind: Column, op: Column) -> Column:
    size = F.substring(value, F.lit(2), F.length(value))
    return F.when(~F.startswith(value, F.lit("-")), value).when(kind == "suffix", F.concat(size, op)).when(kind == "prefix", F.concat(op, size)).otherwise(value)


def symbol_pool(prompt: Column) -> Column:
    """Distinct characters that aren't white space, in code-point order."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(squash(prompt), ""))), "")


def squash(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def example_count(prompt: Column) -> Column:
    """The largest EX number, 0 without any."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(prompt, F.lit(r"EX(\d+)"), F.lit(1)), lambda s: s.cast("int"))), F.lit(0))


def runs_text(values: Column) -> Column:
    """A sorted array of whole numbers as text, runs of three or more as low-high."""
    at = F.zip_with(values, F.sequence(F.lit(0), F.size(values) - 1), lambda v, i: F.struct(v.alias("v"), (v - i).alias("g")))
    groups = F.array_distinct(F.transform(at, lambda s: s["g"]))
    shown = F.transform(groups, lambda g: F.transform(F.filter(at, lambda s: s["g"] == g), lambda s: s["v"]))
    joined = F.transform(shown, lambda r: F.when(F.size(r) >= 3, F.concat(r[0].cast("string"), F.lit("-"), F.element_at(r, -1).cast("string"))).otherwise(F.array_join(F.transform(r, lambda v: v.cast("string")), ",")))
    return F.when(F.size(values) == 0, "").otherwise(F.array_join(joined, ","))


def positional_value(symbols: Column, digits: Column, little_endian: Column) -> Column:
    """The number that an array of symbols stands for under a map of digits."""
    order = F.when(little_endian, F.reverse(symbols)).otherwise(symbols)
    return F.aggregate(order, F.lit(0).cast("long"), lambda acc, s: acc * 10 + F.try_element_at(digits, s))


def leading_symbols(terms: Column) -> Column:
    """First symbols of terms of two or more: they can't be zero."""
    return F.array_distinct(F.transform(F.filter(terms, lambda t: F.length(t) > 1), lambda t: F.substring(t, 1, 1)))
