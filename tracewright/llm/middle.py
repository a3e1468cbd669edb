"""Fill-in-the-middle: texts cut into units, and the units between two of their bounds moved to the end.

A unit grammar says, by classes of neighbouring characters, where a text is
cut: between a place whose left side is of one class and whose right side is of
another. `boundary` puts those places into one regex that looks to both sides
and matches nothing itself, so that Spark's split gives all pieces with nothing
lost between them. The empty text would be one empty piece; it has no unit.

The two cuts, the form and the order of a document follow from a digest of its
id and nothing else, so reruns and lost tasks give the same output.

Defined cases: a null text is empty; an empty text, one that holds a sentinel
and the share that `plain_from` names stay as they are (form plain); a null id
has an empty name, and rows that share an id share their draws; rows are neither
merged nor dropped; an empty table gives an empty result; of other columns those
in `keep` are passed through, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Character classes of the grammars; the dot is any code point, line breaks too.
ANY, SPACE, MARK, LETTER, DIGIT = r".", r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]", r"\p{L}", r"[0-9]"
OTHER = r"[^\p{L}0-9\x20\x09-\x0D]"
STOP = r"[.!?]"


@dataclass(frozen=True)
class Grammar:
    """breaks are pairs of what stands left and right of a cut: classes, or short runs of them; never are pairs where there's none all the same."""

    breaks: tuple[tuple[str, str], ...]
    never: tuple[tuple[str, str], ...] = ()


GRAMMARS = {
    "code point": Grammar(((ANY, ANY),)),
    "grapheme": Grammar(((ANY, ANY),), ((ANY, r"[\p{M}‍️]"), (r"‍", ANY), (r"\r", r"\n"))),
    "word": Grammar(((SPACE, MARK),)),
    "token": Grammar(((LETTER, r"[^\p{L}]"), (DIGIT, r"[^0-9]"), (SPACE, MARK), (OTHER, ANY))),
    "line": Grammar(((r"\n", ANY),)),
    "sentence": Grammar(((STOP + SPACE, MARK), (r"\n", MARK))),
}


def boundary(grammar: Grammar) -> str:
    """The regex of a grammar's cuts. It has no width; each side is looked at alone."""
    looks = "|".join(f"(?<={left})(?={right})" for left, right in grammar.breaks)
    nots = "".join(f"(?!(?<={left})(?={right}))" for left, right in grammar.never)
    return f"(?s){nots}{looks}" if len(grammar.breaks) == 1 else f"(?s){nots}(?:{looks})"


def units(text: Column, grammar: Grammar) -> Column:
    """The pieces of a text in order; together they are the text. A null or empty text has none."""
    return F.when(F.coalesce(F.octet_length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        # else a sentinel could arise where a piece and a sentinel meet, and the output could be read in two ways
        for i, a in enumerate(marks):
            for j, b in enumerate(marks):
                if not a or (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                    raise ValueError(f"sentinels {a!r} and {b!r} overlap")

    def regex(self) -> str:
        return "|".join(re.escape(m) for m in (self.prefix, self.suffix, self.middle))


def draws(doc_id: Column, seed: str = "1:") -> list[Column]:
    """Four unsigned 32-bit numbers of the digest of a document's id."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, grammar: Grammar = GRAMMARS["code point"], plain_from: int = 90, spm_below: int = 20, sentinels: Sentinels = Sentinels(), seed: str = "1:", doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every row, and the columns of `keep`.

    A document is plain where its third number % 100 is plain_from or more; of
    the others those whose fourth number % 100 is below spm_below have the suffix
    first (spm), the rest the prefix first (psm).
    """
    s = sentinels
    rows = docs.select(F.struct(*(F.col(f"`{c}`").alias(c) for c in keep or [])).alias("kept") if keep else F.lit(None).alias("kept"), F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    first, second, third, fourth = draws(F.col("doc_id"), seed)
    # each select names its columns more than once above, so Spark keeps the steps apart and splits a text once
    cut = rows.select("kept", "doc_id", "text", units(F.col("text"), grammar).alias("units"), first.alias("h1"), second.alias("h2"), third.alias("h3"), fourth.alias("h4"))
    n = F.size("units").cast("long")
    marked = F.greatest(*(F.instr("text", m) for m in (s.prefix, s.suffix, s.middle))) > 0
    form = F.when((n == 0) | marked | (F.col("h3") % 100 >= plain_from), "plain").when(F.col("h4") % 100 < spm_below, "spm").otherwise("psm")
    ends = [F.col(h) % (n + 1) for h in ("h1", "h2")]
    placed = cut.select("kept", "doc_id", "text", "units", n.alias("n"), form.alias("form"), F.least(*ends).cast("int").alias("a"), F.greatest(*ends).cast("int").alias("b"))
    joined = lambda start, length: F.array_join(F.slice("units", start, length), "")
    parts = F.when(F.col("form") != "plain", F.struct(joined(F.lit(1), F.col("a")).alias("prefix"), joined(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"), joined(F.col("b") + 1, F.size("units") - F.col("b")).alias("suffix")))
    told = placed.select("kept", "doc_id", "text", "n", "form", parts.alias("p"))
    spm = F.concat(F.lit(s.suffix), "p.suffix", F.lit(s.prefix), "p.prefix", F.lit(s.middle), "p.middle")
    psm = F.concat(F.lit(s.prefix), "p.prefix", F.lit(s.suffix), "p.suffix", F.lit(s.middle), "p.middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", spm).otherwise(psm)
    return told.select(*(F.col(f"kept.`{c}`") for c in keep or []), "doc_id", "n", "form", F.length("p.prefix").cast("long").alias("prefix_chars"), F.length("p.middle").cast("long").alias("middle_chars"), output.alias("output"))


def restored(made: DataFrame, sentinels: Sentinels = Sentinels(), out: str = "restored") -> DataFrame:
    """made (form, output) with the text of each output: the pieces between its sentinels, in the order of the text."""
    pieces = F.when(F.col("form") != "plain", F.split("output", sentinels.regex(), -1))
    joined = lambda *at: F.concat(*(F.col("__pieces")[i] for i in at))
    read = F.when(F.col("form") == "plain", F.col("output")).when(F.col("form") == "spm", joined(2, 3, 1)).otherwise(joined(1, 3, 2))
    return made.select("*", pieces.alias("__pieces")).select(*made.columns, read.alias(out))


def digests(made: DataFrame, sentinels: Sentinels = Sentinels()) -> DataFrame:
    """Rows of transform() with SHA-256 of the output and of the text that is read out of it, in place of the output."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return restored(made, sentinels, "__restored").select(*(f"`{c}`" for c in made.columns if c != "output"), sha("output").alias("output_sha256"), sha("__restored").alias("restored_sha256"))
