"""Personal data with offset-preserving deobfuscation.

Plain identifiers (the base) are found in the text as it stands. Transducers
then rewrite what may hide others: look-alike and full-width signs, invisible
signs, spelled digits, and at / dot disguises. Each sign they write remembers
the source span that it came from, so identifiers found in the rewritten text
have offsets in the source. A found span that lies in a base span of its kind
says nothing new; one that reaches further is added, and the base stays.

Defined cases: null text is empty; a match that fails its check (Luhn, digits,
parts) is dropped and not tried again shorter; spans of different kinds may
overlap; repeated rows are read each by itself; an empty table gives an empty
result; extra columns aren't read. Offsets are in code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Digits and what ips, cards and phones have between them: every match of theirs lies in such a run.
ZONE = re.compile(r"[+0-9][0-9 .()+\-]{6,}")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = str.maketrans("", "", " .()+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The plain identifiers, by kind and then by start."""
    emails, ips, cards, phones = [], [], [], []
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            emails.append(("email", start, m.end()))
            low = m.end()
        else:
            low = at + 1
        at = text.find("@", low)
    for zone in ZONE.finditer(text):
        a, b = zone.span()
        for m in IP.finditer(text, a, b):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                ips.append(("ip", *m.span()))
        for m in CARD.finditer(text, a, b):
            digits = m[0].translate(DIGITS)
            if 13 <= len(digits) <= 19 and luhn(digits):
                cards.append(("card", *m.span()))
        for m in PHONE.finditer(text, a, b):
            if 9 <= len(m[0].translate(DIGITS)) <= 15:
                phones.append(("phone", *m.span()))
    return emails + ips + cards + phones


# Look-alikes of Latin letters and of signs in identifiers. Full-width forms and digits of other scripts follow from rules.
LOOKALIKES = dict(
    zip(
        "абвгеіјкмнорстухѕԁԛԝһАВЕІЈКМНОРСТУХЅαβγεηικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "a6Breijkmhopctyxsdqwh" + "ABEIJKMHOPCTYXS" + "aByenikvoptux" + "ABEZHIKMNOPTYX",
        strict=True,
    )
)
SIGNS = {
    "\ufe6b": "@", "\u3002": ".", "\u2024": ".", "\ufe52": ".", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-", "\ufe63": "-", "\u00a0": " ", "\u202f": " ", "\u2009": " ", "\ufe62": "+",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Words of English, German, French and Spanish for digits, plus, dot and at; at stands for itself only beside another disguise.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
PLUS_WORDS, DOT_WORDS, AT_WORDS = ("plus", "más"), ("dot", "point", "punkt", "punto"), ("klammeraffe", "arobase", "arroba")

LETTER = r"[^\W\d_]"
#: Words, and figures, as what digits in words are read from.
PARTS = re.compile(rf"{LETTER}+|[0-9]+")
GAP = re.compile(r"[\s,.\-]+")
#: Where an address may have its sign; what follows says whether it's one.
SIGN = re.compile(rf"@|(?<!{LETTER})(?:at|{'|'.join(AT_WORDS)})(?!{LETTER})", re.I)
POINT = re.compile(rf"(?:{'|'.join(DOT_WORDS)})(?!{LETTER})", re.I)
LABEL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?")
OPEN, CLOSE = "[({<", "])}>"
#: What follows a plain "at" in prose, and never names a host.
DETERMINERS = frozenset("the a an this that these those our my your his her their its".split())
#: What a word may hint at: digits or plus (1), an at that is sure (2), a dot (3).
HINTS = dict.fromkeys([*DIGIT_WORDS, *PLUS_WORDS], 1) | dict.fromkeys(AT_WORDS, 2) | dict.fromkeys(DOT_WORDS, 3)
WORDS = re.compile(rf"{LETTER}+")
BRACKETED = re.compile(rf"[\[({{<]\s*+(?:at|@|{'|'.join((*AT_WORDS, *DOT_WORDS))}|\.)|@\s|\s\.\s", re.I)
RUN, FIGURE = re.compile(rb"[\x01\x03]{2}"), re.compile("[0-9]")
ODD_SIGNS = frozenset([*LOOKALIKES, *SIGNS, *INVISIBLE, *map(chr, range(0xFF01, 0xFF5F)), *(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isdecimal())])


class Rewriting:
    """A text with, for each of its code points, the span of the source that it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, None, None

    def replace(self, edits: list[tuple[int, int, str]]) -> Rewriting:
        """edits: (start, end, by what) in this text, in order and apart. Each sign written stands for all that it replaces."""
        if not edits:
            return self
        starts = self.starts or list(range(len(self.text)))
        ends = self.ends or list(range(1, len(self.text) + 1))
        out, s, e, at = [], [], [], 0
        for a, b, new in edits:
            out += (self.text[at:a], new)
            s += starts[at:a] + [starts[a]] * len(new)
            e += ends[at:a] + [ends[b - 1]] * len(new)
            at = b
        out.append(self.text[at:])
        made = Rewriting("".join(out))
        made.starts, made.ends = s + starts[at:], e + ends[at:]
        return made

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])


def _sign(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if "\uff01" <= c <= "\uff5e":
        return chr(ord(c) - 0xFEE0)
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    return LOOKALIKES.get(c) or SIGNS.get(c, c)


def plain_signs(r: Rewriting) -> Rewriting:
    odd = ODD_SIGNS.intersection(r.text)
    return r.replace([(m.start(), m.end(), _sign(m[0])) for m in re.finditer(f"[{re.escape(''.join(sorted(odd)))}]", r.text)]) if odd else r


def _blank(text: str, at: int, step: int, low: int, high: int) -> int:
    """The end of the white space that begins at `at`, to the right (step 1) or before it (step -1)."""
    while low < at and step < 0 and text[at - 1].isspace():
        at -= 1
    while at < high and step > 0 and text[at].isspace():
        at += 1
    return at


def _framed(text: str, a: int, b: int, low: int, high: int) -> tuple[int, int, bool, bool]:
    """A sign at a..b with its brackets and white space: start, end, whether brackets are around it, whether white space is on both sides."""
    l, r = _blank(text, a, -1, low, high), _blank(text, b, 1, low, high)
    if l > low and r < high and text[l - 1] in OPEN and text[r] in CLOSE:
        return _blank(text, l - 1, -1, low, high), _blank(text, r + 1, 1, low, high), True, False
    return l, r, False, l < a and b < r


def _dot(text: str, at: int, low: int, high: int, spaced: bool) -> tuple[int, bool] | None:
    """The end of a dot that begins at `at`, and whether it is disguised. spaced: a plain dot may stand between blanks."""
    if at < high and text[at] == ".":
        return (at + 1, False) if at + 1 < high and not text[at + 1].isspace() else None
    i = _blank(text, at, 1, low, high)
    bracket = i < high and text[i] in OPEN
    if bracket:
        i = _blank(text, i + 1, 1, low, high)
    m = POINT.match(text, i, high)
    end = m.end() if m else i + 1 if i < high and text[i] == "." and (bracket or (spaced and i > at)) else 0
    if not end:
        return None
    after = _blank(text, end, 1, low, high)
    if bracket:
        return (_blank(text, after + 1, 1, low, high), True) if after < high and text[after] in CLOSE else None
    return (after, True) if i > at and after > end else None


def _dot_before(text: str, at: int, low: int, spaced: bool) -> tuple[int, bool] | None:
    """The start of a dot that ends at `at`, and whether it is disguised."""
    if at > low and text[at - 1] == ".":
        return at - 1, False
    i = _blank(text, at, -1, low, at)
    bracket = i > low and text[i - 1] in CLOSE
    if bracket:
        i = _blank(text, i - 1, -1, low, at)
    start = next((i - len(w) for w in DOT_WORDS if text[max(low, i - len(w)) : i].lower() == w), 0)
    if start and start > low and text[start - 1].isalpha():
        start = 0
    if not start and i > low and text[i - 1] == "." and (bracket or (spaced and i < at)):
        start = i - 1
    if not start:
        return None
    before = _blank(text, start, -1, low, at)
    if bracket:
        return (_blank(text, before - 1, -1, low, at), True) if before > low and text[before - 1] in OPEN else None
    return (before, True) if i < at and before < start else None


def _part_before(text: str, at: int, low: int) -> int:
    while at > low and (text[at - 1] in LOCAL and text[at - 1] != "."):
        at -= 1
    return at


def _address(text: str, a: int, b: int, low: int) -> tuple[list[tuple[int, int, str]], int] | None:
    """Edits that make an address with its sign at a..b plain, and where it ends; None where there's none or it's plain already.

    First the domain is read to the right, then the local part to the left, not
    beyond what an address before took: each stretch of a text is read a few times
    however often what might be a sign stands in it.
    """
    high, word = len(text), text[a] != "@"
    left, right, bracket, blanks = _framed(text, a, b, low, high)
    if (word and not bracket and not blanks) or left == low or text[left - 1] not in LOCAL or text[left - 1] == ".":
        return None
    hard = bracket or (word and text[a:b].lower() in AT_WORDS)
    m = LABEL.match(text, right)
    if not m or (word and not hard and m[0].lower() in DETERMINERS):
        return None
    edits, end, dots, disguised = [(left, right, "@")] if bracket or word or left < a or b < right else [], m.end(), 0, False
    while (d := _dot(text, end, low, high, not word)) is not None and (m := LABEL.match(text, d[0])):
        if d[1]:
            edits.append((end, d[0], "."))
            disguised = True
        dots, end = dots + 1, m.end()
    if not dots or not (hard or disguised):
        return None
    start, before = _part_before(text, left, low), []
    letters = start
    while left - start == 1 and letters - 2 >= low and text[letters - 1] == " " and text[letters - 2].isalnum() and (letters - 2 == low or text[letters - 3].isspace()):
        letters -= 2
    if (start - letters) // 2 >= 2:  # single signs with a blank between: three or more are a name in pieces
        before = [(i - 1, i, "") for i in range(letters + 2, start + 1, 2)]
        start = letters
    while (d := _dot_before(text, start, low, not word)) is not None and (part := _part_before(text, d[0], low)) < d[0]:
        if d[1]:
            before.append((d[0], start, "."))
        start = part
    if start > low and text[start - 1] in LOCAL:
        return None
    return sorted(before) + edits, end


def plain_addresses(r: Rewriting) -> Rewriting:
    edits, low, at = [], 0, SIGN.search(r.text)
    while at:
        found = _address(r.text, *at.span(), low)
        if found:
            edits += found[0]
            low = found[1]
        at = SIGN.search(r.text, max(low, at.end()))
    return r.replace(edits)


def _spelled(run: list[tuple[int, int, str, bool]]) -> list[tuple[int, int, str]]:
    """Edits for a run of parts (start, end, what it says, whether in words). Dots stand between digits; figures keep what is between them."""
    while run and run[-1][2] in ".+":
        run.pop()
    while run and run[0][2] == ".":
        run.pop(0)
    if len(run) < 2 or not any(p[3] for p in run):
        return []
    edits = []
    for i, (a, b, said, words) in enumerate(run):
        if i and (words or run[i - 1][3]):
            edits.append((run[i - 1][1], a, ""))
        if words:
            edits.append((a, b, said))
    return edits


def plain_digits(r: Rewriting) -> Rewriting:
    edits, run, end = [], [], 0
    for m in PARTS.finditer(r.text):
        part = m[0].lower()
        said = part if "0" <= part[0] <= "9" else DIGIT_WORDS.get(part) or ("+" if part in PLUS_WORDS else "." if part in DOT_WORDS else "")
        if run and (not said or said == "+" or (said == "." and run[-1][2] in ".+") or not GAP.fullmatch(r.text, end, m.start())):
            edits += _spelled(run)
            run = []
        if said:
            run.append((m.start(), m.end(), said, not "0" <= part[0] <= "9"))
        end = m.end()
    return r.replace(edits + _spelled(run))


def hints(text: str) -> tuple[bool, bool]:
    """Whether a text may hold a disguised address, and spelled digits.

    Every disguised address has a bracket or blanks beside a sign, or a word for an
    at that is sure or for a dot; digits in words are two words next to each other
    for digits, plus or dots, or one beside a figure. One pass over the words says
    so for far less than reading them does.
    """
    codes = bytes(map(HINTS.get, WORDS.findall(text.casefold()), repeat(0)))
    mixed = (b"\x01" in codes or b"\x03" in codes) and FIGURE.search(text) is not None
    return b"\x02" in codes or b"\x03" in codes or BRACKETED.search(text) is not None, mixed or RUN.search(codes) is not None


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, both by kind and then by start."""
    base = base_spans(text)
    r = Rewriting(text)
    if not text.isascii():
        r = plain_signs(r)
    addresses, digits = hints(r.text)
    if addresses:
        r = plain_addresses(r)
    if digits:
        r = plain_digits(r)
    if r.starts is None:
        return base, base
    every = base[:]
    for kind, a, b in base_spans(r.text):
        a, b = r.source(a, b)
        if not any(k == kind and s <= a and b <= e for k, s, e in base):
            every.append((kind, a, b))
    every.sort(key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
    return base, every


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans as text, of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            base, every = [], []
            for t in batch.column(1).to_pylist():
                b, e = find(t or "")
                base.append(written(b))
                every.append(written(e))
            counts = [pa.array([x.count(f"{k}:") for x in base], pa.int64()) for k in KINDS]
            sums = [hashlib.sha256(x.encode()).hexdigest() for x in base]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(sums, pa.string()), pa.array(every, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    source = docs.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t"))
    kind = source.schema["d"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
