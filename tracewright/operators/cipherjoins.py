"""How many solutions ciphers have, up to a number, by joins in place of a search.

Letters stand for different digits, so an equation's letters repeat exactly where
its digits do: what it allows is the rows of a table of all equations of its
variant with the same shape, about a hundred. A cipher's equations are joined one
after the other on the letters they share, many ciphers at a time.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from tracewright.operators.ciphers import COUNT
from tracewright.operators.solve import number

#: Places of an equation: two operands of two, four of the result.
PLACES = 8
TENS = 10 ** np.arange(PLACES, dtype=np.int64)
#: Rows that are joined at once.
ROWS = 300_000


def _shape(words: np.ndarray, minus: np.ndarray) -> np.ndarray:
    """A number for each equation (row of places, -1 where there is none): where each place's digit or letter is first, and the sign."""
    first = (words[:, :, None] == words[:, None, :]).argmax(2)
    return np.where(words < 0, 9, first) @ TENS * 2 + minus


@cache
def _table(variant: str) -> tuple[np.ndarray, np.ndarray]:
    """Shapes and digits (-1 where there is no place) of all equations of a variant; no number of several digits begins with 0."""
    a, b = (x.ravel() for x in np.meshgrid(np.arange(100), np.arange(100), indexing="ij"))
    out = np.array([number(variant, x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    minus = out < 0
    # a result of 0 may have a minus
    again = np.flatnonzero(out == 0)
    a, b, out, minus = np.append(a, a[again]), np.append(b, b[again]), np.append(out, out[again]), np.append(minus, out[again] == 0)
    words = np.full((len(a), PLACES), -1, np.int64)
    for at, most, x in ((0, 2, a), (2, 2, b), (4, 4, np.abs(out))):
        size = np.maximum(1, (x[:, None] >= TENS[1:most]).sum(1) + 1)
        for i in range(most):
            words[:, at + i] = np.where(i < size, x // 10 ** np.maximum(size - 1 - i, 0) % 10, -1)
    return _shape(words, minus), words.astype(np.int8)


class Tables:
    """The tables of some variants as one, with an index for each set of places."""

    def __init__(self, variants: tuple[str, ...]) -> None:
        parts = [_table(v) for v in variants]
        shapes = np.concatenate([s * len(variants) + i for i, (s, _) in enumerate(parts)])
        self.shapes, self.of, self.sizes = np.unique(shapes, return_inverse=True, return_counts=True)
        self.words = np.concatenate([w for _, w in parts])
        self.used = np.bitwise_or.reduce(np.where(self.words < 0, 0, np.int16(1) << np.maximum(self.words, 0).astype(np.int16)), axis=1).astype(np.int16)
        self.digits = np.maximum(self.words, 0).astype(np.int64)
        self.indexes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def index(self, places: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows in the order of their keys, and the keys: shape, and digits at the places of the mask."""
        if places not in self.indexes:
            key = self.key(self.of, self.digits, places)
            order = np.argsort(key, kind="stable")
            self.indexes[places] = (order, key[order])
        return self.indexes[places]

    @staticmethod
    def key(shape: np.ndarray, digits: np.ndarray, places: int) -> np.ndarray:
        key = shape.astype(np.int64) * 10**PLACES
        for j in range(PLACES):
            if places >> j & 1:
                key += digits[:, j] * TENS[j]
        return key


@cache
def tables(variants: tuple[str, ...]) -> Tables:
    return Tables(variants)


def has_room(equations: list[tuple[str, str, str, str]], families: dict[str, list[str]]) -> bool:
    """Whether a cipher's numbers have the places here, its letters digits, and each of its signs one variant."""
    letters = {c for a, _, b, out in equations for c in a + b + out.removeprefix("-")}
    return bool(equations) and len(letters) <= 10 and " " not in letters and all(len(v) == 1 for v in families.values()) and all(0 < len(a) <= 2 and 0 < len(b) <= 2 and "-" not in a + b and 0 < len(out.removeprefix("-")) <= 4 for a, _, b, out in equations)


def solution_counts(ciphers: list[tuple[list[tuple[str, str, str, str]], dict[str, list[str]]]], most: int = 2, step: int = 2000) -> np.ndarray:
    """Of each cipher (equations, and the one variant of each sign) how many solutions it has, `most` where there are more."""
    variants = tuple(sorted({v for _, families in ciphers for vs in families.values() for v in vs}))
    parts = [_counts(ciphers[at : at + step], variants, most) for at in range(0, len(ciphers), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _counts(ciphers: list, variants: tuple[str, ...], most: int) -> np.ndarray:
    known, n = tables(variants), len(ciphers)
    place = {v: i for i, v in enumerate(variants)}
    sizes = np.array([len(e) for e, _ in ciphers])
    flat = [(f"{a:2}{b:2}{out.removeprefix('-'):4}", out[0] == "-", place[families[op][0]]) for e, families in ciphers for a, op, b, out in e]
    text = np.array([t for t, _, _ in flat], f"U{PLACES}").view(np.uint32).reshape(-1, PLACES).astype(np.int64)
    text[text == 32] = -1
    shape = _shape(text, np.array([m for _, m, _ in flat])) * len(variants) + np.array([v for _, _, v in flat])
    at = np.minimum(np.searchsorted(known.shapes, shape), len(known.shapes) - 1)
    there = known.shapes[at] == shape
    # letters of each puzzle by number; the eleventh is no letter
    puzzle, first = np.repeat(np.arange(n), sizes), np.cumsum(sizes) - sizes
    letters, number_of = np.unique((puzzle[:, None] << 32) + text, return_inverse=True)
    number_of = number_of.reshape(text.shape)
    real = (letters & 0xFFFFFFFF) != 0xFFFFFFFF
    owner = np.where(real, letters >> 32, (letters + 1) >> 32)
    begins = np.searchsorted(owner[real], np.arange(n))
    rank = np.full(len(letters), 10)
    rank[real] = np.arange(real.sum()) - begins[owner[real]]
    letter = rank[number_of].astype(np.int16)
    masks = np.bitwise_or.reduce((1 << letter) & 1023, axis=1)
    most_equations = int(sizes.max())
    grid = np.full((n, most_equations), -1)
    grid[puzzle, np.arange(len(puzzle)) - first[puzzle]] = np.arange(len(puzzle))

    # of each puzzle the next equation is the one that leaves least: rows of its table, a tenth for each letter that is known
    size, bits = np.log10(known.sizes[at]), np.where(grid < 0, 0, masks[grid])
    order, have, places = np.full_like(grid, -1), np.zeros(n, np.int64), np.zeros(len(flat), np.int64)
    total = np.zeros((n, most_equations), np.int8)
    cost = np.where(grid < 0, np.inf, size[grid])
    done = grid < 0
    for k in range(most_equations):
        pick = np.where(done, np.inf, cost - COUNT[bits & have[:, None]]).argmin(1)
        mine = np.flatnonzero(k < sizes)
        e = grid[mine, pick[mine]]
        order[mine, k] = e
        done[mine, pick[mine]] = True
        places[e] = (((have[mine][:, None] >> letter[e]) & 1 == 1) @ (1 << np.arange(PLACES))).astype(np.int64)
        have[mine] |= masks[e]
        total[mine, k] = COUNT[have[mine]]

    found, whole = np.zeros(n, np.int64), np.ones(n, bool)
    whole[puzzle[~there]] = False
    start = np.flatnonzero(whole)
    stack = [(0, start, np.zeros((len(start), 11), np.int8), np.zeros(len(start), np.int16))]
    while stack:
        k, p, digits, used = stack.pop()
        going = found[p] < most
        p, digits, used = p[going], digits[going], used[going]
        e = order[p, k]
        joined = []
        for mask in np.unique(places[e]).tolist():
            r = np.flatnonzero(places[e] == mask)
            rows, keys = known.index(mask)
            asked = known.key(at[e[r]], np.take_along_axis(digits[r], letter[e[r]], 1), mask)
            low, high = np.searchsorted(keys, asked), np.searchsorted(keys, asked, side="right")
            many = high - low
            for piece in np.split(np.arange(len(r)), np.flatnonzero(np.diff(np.cumsum(many) // ROWS)) + 1):
                times = many[piece]
                source = np.repeat(r[piece], times)
                row = rows[np.arange(len(source)) - np.repeat(np.cumsum(times) - times - low[piece], times)]
                after = used[source] | known.used[row]
                good = COUNT[after] == total[p[source], k]
                source, row, after = source[good], row[good], after[good]
                last = sizes[p[source]] == k + 1
                np.add.at(found, p[source[last]], 1)
                source, row, after = source[~last], row[~last], after[~last]
                if len(source):
                    new = digits[source]
                    np.put_along_axis(new, letter[e[source]].astype(np.int64), np.maximum(known.words[row], 0), 1)
                    joined.append((p[source], new, after))
        if joined:
            p, digits, used = (np.concatenate(x) for x in zip(*joined, strict=True))
            stack += [(k + 1, p[i : i + ROWS], digits[i : i + ROWS], used[i : i + ROWS]) for i in range(0, len(p), ROWS)]
    return np.minimum(found, most)
