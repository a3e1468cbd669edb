"""Answer extraction and text scalars as Column expressions; no Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_FOUND = "NOT_FOUND"
# Phrases before an answer, in the order in which they are tried.
PHRASES = [r"(?i)The final answer is:\s*([^\n]+)", r"(?i)Final answer is:\s*([^\n]+)", r"(?i)Final answer\s*[:：]\s*([^\n]+)"]
NUMBER = r"-?\d+(?:\.\d+)?"


def strip(text: Column) -> Column:
    """White space of either end, line breaks and tabs included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def boxes_live(text: Column) -> Column:
    """The inside of each box, up to the last closing brace before the next box; all of it where there is none."""
    parts = F.split(text, r"\\boxed\{", -1)
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(inner, lambda s: F.when(F.contains(s, F.lit("}")), F.regexp_extract(s, r"(?s)^(.*)\}", 1)).otherwise(s))


def boxed_live(text: Column) -> Column:
    """The last box that isn't blank, else the last box; null without any."""
    boxes = F.transform(boxes_live(text), strip)
    return F.coalesce(last(F.filter(boxes, lambda s: s != "")), last(boxes))


def boxed_legacy(text: Column) -> Column:
    """As boxed_live, with a box ending at the first closing brace."""
    boxes = F.transform(F.regexp_extract_all(text, F.lit(r"\\boxed\{([^}]*)(?:\}|\z)"), F.lit(1)), strip)
    return F.coalesce(last(F.filter(boxes, lambda s: s != "")), last(boxes))


def answer_phrase(text: Column) -> Column:
    return F.coalesce(*(strip(last(F.regexp_extract_all(text, F.lit(p), F.lit(1)))) for p in PHRASES))


def last_number(text: Column) -> Column:
    return last(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))


def last_line(text: Column) -> Column:
    lines = F.transform(F.split(text, r"\R", -1), strip)
    return last(F.filter(lines, lambda s: s != ""))


def final_answer(text: Column, boxed=boxed_live) -> Column:
    """Box, else phrase, else number, else last line, else NOT_FOUND; only the first that applies is computed."""
    return F.coalesce(boxed(text), answer_phrase(text), last_number(text), last_line(text), F.lit(NOT_FOUND))


def first_box(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?s)\\?boxed\{(.*?)\}", 1), F.lit(""))


def strip_boxes(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\boxed\{[^}]*\}", ""), r"\s+$", "")


def split_thinking(text: Column) -> tuple[Column, Column]:
    """(thinking, answer): cut at the first </think>; without one all is answer."""
    parts = F.split(text, "</think>", 2)
    cut = F.size(parts) == 2
    thinking = F.when(cut, strip(F.regexp_replace(parts[0], r"^\s*<think>", ""))).otherwise(F.lit(""))
    return thinking, strip(F.when(cut, F.try_element_at(parts, F.lit(2))).otherwise(text))


def first_difference(a: Column, b: Column) -> Column:
    """Index of the first differing character; -1 where equal or null; the shorter length where one begins the other."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    return F.when(a.isNull() | b.isNull() | (a == b), F.lit(-1)).otherwise(F.array_position(pairs, False).cast("int") - 1)


def snippet(text: Column, needle: str, around: int) -> Column:
    """Characters around the first hit, line breaks as spaces; null without a hit."""
    at = F.locate(needle, text)
    begin = F.greatest(F.lit(1), at - around)
    piece = F.substring(text, begin, at - begin + F.lit(len(needle) + around))
    return F.when(at > 0, F.translate(piece, "\n", " "))


def id_stem(col: Column) -> Column:
    return F.regexp_replace(col, r"-(d|p)\d+$", "")


def hash_id(text: Column, prefix: str = "aug", digits: int = 8) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(text.cast("binary")), 1, digits))


def ascii_safe(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def insert_before(text: Column, marker: str, block: Column) -> Column:
    """block before the first marker; the text as it is without one."""
    at = F.locate(marker, text)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), block, F.substring(text, at, F.length(text)))).otherwise(text)


def first_match(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule (regex, name) that the text holds."""
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out
