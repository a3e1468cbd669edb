"""Recall of generated disguises in four languages, and clean text left alone."""

import collections
import random

import pytest

from tracewright.llm import pii

SPELLED = {
    "en": ("zero one two three four five six seven eight nine".split(), "plus", "dot", ["at"]),
    "de": ("null eins zwei drei vier fünf sechs sieben acht neun".split(), "plus", "punkt", ["klammeraffe", "at"]),
    "fr": ("zéro un deux trois quatre cinq six sept huit neuf".split(), "plus", "point", ["arobase"]),
    "es": ("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "más", "punto", ["arroba"]),
}
FILLER = {"en": "please write to us today or call", "de": "bitte schreiben sie uns heute oder rufen", "fr": "merci de nous écrire ou appeler", "es": "por favor escriba hoy o llame"}
WIDE = {c: chr(ord(c) + 0xFEE0) for c in map(chr, range(33, 127))}


def luhn(rng):
    body = [rng.randrange(10) for _ in range(15)]
    total = sum((d * 2 - 9 * (d > 4)) if i % 2 == 0 else d for i, d in enumerate(body))
    return "".join(map(str, body)) + str(-total % 10)


def disguised(rng, lang):
    """(kind, how, shown)"""
    digits, plus, dot, ats = SPELLED[lang]
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    say = lambda number: rng.choice([" ", ", ", " - "]).join(digits[int(c)] for c in number)
    local, host = ".".join(word() for _ in range(rng.randrange(1, 7))), [word() for _ in range(rng.randrange(1, 4))] + [rng.choice(["com", "org", "de", "fr", "es"])]
    at, left, right = rng.choice(ats), *rng.choice(["[]", "()", "{}", "<>"])
    phone = "".join(str(rng.randrange(10)) for _ in range(rng.randrange(9, 13)))
    ip = [str(rng.randrange(256)) for _ in range(4)]
    zero = rng.choice("०٠๐০")
    some = lambda number: " ".join(digits[int(c)] if i == 2 or rng.random() < 0.5 else c for i, c in enumerate(number))
    other = lambda s: "".join(chr(ord(zero) + int(c)) if c.isdigit() else c for c in s)
    return rng.choice(
        [
            ("email", "words", f"{local} {at} {f' {dot} '.join(host)}"), ("email", "brackets", f"{local} {left}{at}{right} {f' {left}{dot}{right} '.join(host)}"), ("email", "bracketed at", f"{local}{left}{at}{right}{'.'.join(host)}"),
            ("email", "wide", "".join(WIDE.get(c, c) for c in f"{local}@{'.'.join(host)}")), ("email", "invisible", f"{local[0]}\u200b{local[1:]}@{'.'.join(host)}".replace(host[0], host[0][0] + "\u200d" + host[0][1:], 1)),
            ("email", "look-alikes", f"{local}@{'.'.join(host)}".replace("a", "а").replace("o", "о").replace("e", "е")), ("email", "dot in brackets", f"{local}@{f'{left}.{right}'.join(host)}"),
            ("phone", "words", f"{plus} {say(phone)}"), ("phone", "digits of a script", f"+{other(phone)}"), ("ip", "words", f" {dot} ".join(say(p) for p in ip)), ("ip", "wide", "".join(WIDE.get(c, c) for c in ".".join(ip))),
            ("phone", "figures and words", f"+{phone[0]} {some(phone[1:])}"), ("ip", "spelled dots", f" {dot} ".join(ip)), ("card", "figures and words", some(luhn(rng))), ("email", "blanks", f"{local} @ {' . '.join(host)}"),
            ("card", "words", say(luhn(rng))), ("card", "digits of a script", other(luhn(rng))),
        ]
    )


@pytest.mark.parametrize("lang", sorted(SPELLED))
def test_recall_of_disguises(lang):
    rng = random.Random(f"pii {lang}")
    hit, seen = collections.Counter(), collections.Counter()
    for _ in range(5000):
        kind, how, shown = disguised(rng, lang)
        before, after = FILLER[lang] + ": ", rng.choice([" ;", " !", "\n\n", " / " + FILLER[lang]])
        base, every = pii.find(before + shown + after)
        assert set(base) <= set(every)
        seen[kind, how] += 1
        hit[kind, how] += (kind, len(before), len(before) + len(shown)) in every
    low = {k: round(hit[k] / n, 2) for k, n in seen.items() if hit[k] < 0.9 * n}
    assert not low and len(seen) == 17


def test_text_without_disguises_has_base_spans_alone(spark):
    """Invented prose holds no disguise, so that nothing is added to what the patterns find."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    more = [r["doc_id"] for r in rows if len({*(f := pii.find(r["text"] or ""))[1]} - {*f[0]})]
    assert len(more) <= len(rows) / 500
    clean = ["Sie sah um acht, dass neun oder zehn kamen. Punkt.", "Un point, deux ou trois points. Il en a six, sept au plus.", "Uno de los dos, y punto. Más tres o cuatro.", "Meet at eight at the dot. One or two."]
    assert [pii.find(t)[1] for t in clean] == [[]] * 4
