"""Ciphers in step: the search of `solve.Cipher` over many puzzles, what branches off one node of each at a time.

Domains are masks of ten digits, so that one operation narrows a letter of all
puzzles. What is found and how many nodes it takes are those of `Cipher.solve`:
narrowing ends in the same domains whatever its order, and letters and digits
are branched on in the same order.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

from tracewright.operators.numeric import ARITHMETIC
from tracewright.operators.solve import Cipher, _stem

DIGITS = np.arange(10, dtype=np.int32)
LOW = np.array([0] + [(m & -m).bit_length() - 1 for m in range(1, 1024)], np.int32)
HIGH = np.array([0] + [m.bit_length() - 1 for m in range(1, 1024)], np.int32)
COUNT = np.array([m.bit_count() for m in range(1024)], np.int8)
RANK = {v: i for i, v in enumerate(ARITHMETIC)}
BIT = (1 << np.arange(10)).astype(np.int16)


#: Variants by what they add to.
STEMS: dict[str, list[tuple[int, int]]] = {}
for _v, _r in RANK.items():
    STEMS.setdefault(_stem(_v)[0], []).append((_r, _stem(_v)[1]))
MASK = {stem: sum(1 << r for r, _ in members) for stem, members in STEMS.items()}


def _range(stem: str, a0, a1, b0, b1) -> tuple:
    """Cipher._range over arrays, nothing added."""
    if stem == "mul":
        return a0 * b0, a1 * b1
    if stem == "add":
        return a0 + b0, a1 + b1
    low, high = a0 - b1, a1 - b0
    if stem == "sub_signed":
        return low, high
    if stem == "rsub_signed":
        return -high, -low
    p, q = np.abs(low), np.abs(high)
    low, high = np.where((low <= 0) & (high >= 0), 0, np.minimum(p, q)), np.maximum(p, q)
    return (-high, -low) if stem == "neg_absdiff" else (low, high)


def _fits(c: Cipher) -> bool:
    """Whether a cipher's numbers and variants have room in the arrays here."""
    return all(len(a) <= 4 and len(b) <= 4 and len(out.lstrip("-")) <= 8 and not (a + b).count("-") for a, _, b, out in c.equations) and all(v in RANK for vs in c.families.values() for v in vs) and all([RANK[v] for v in vs] == sorted({RANK[v] for v in vs}) for vs in c.families.values())


def has_room(c: Cipher) -> bool:
    """Whether a cipher can go with others."""
    return len(c.letters()) <= 10 and bool(c.equations) and _fits(c)


class Batch:
    """The equations of ciphers of at most ten letters, as arrays over puzzles."""

    def __init__(self, ciphers: list[Cipher]) -> None:
        self.letters = [c.letters() for c in ciphers]
        self.signs = [list(c.families) for c in ciphers]
        n, most = len(ciphers), max(1, *(len(c.equations) for c in ciphers))
        self.start = np.zeros((n, 10), np.int16)
        self.variants = np.zeros((n, max(1, *map(len, self.signs))), np.int32)
        self.sizes = np.array([len(c.equations) for c in ciphers])
        weight = np.zeros((n, most, 3, 10), np.int32)
        self.sign = np.zeros((n, most), np.int64)
        for p, c in enumerate(ciphers):
            at = {x: i for i, x in enumerate(self.letters[p])}
            for x, digits in c.start().items():
                self.start[p, at[x]] = sum(1 << d for d in digits)
            for s, vs in enumerate(c.families.values()):
                self.variants[p, s] = sum(1 << RANK[v] for v in vs)
            for e, ((_, op, _, _), words) in enumerate(zip(c.equations, c.weights, strict=True)):
                self.sign[p, e] = self.signs[p].index(op)
                for w, places in enumerate(words):
                    for x, place in places.items():
                        weight[p, e, w, at[x]] = place
        self.used = (weight != 0).any(2)
        self.touched = (self.used * BIT).sum(2).astype(np.int16)
        self.weight = np.ascontiguousarray(weight.transpose(1, 2, 0, 3))  # (equation, word, puzzle, letter)
        self.signed = (self.weight < 0).any((1, 2, 3))
        self.there = self.start != 0

    @staticmethod
    def _meets(variants: np.ndarray, x0, x1) -> np.ndarray:
        """Which of each row's variants meet the results; bounds are (word, row, value)."""
        every = int(np.bitwise_or.reduce(variants))
        if every.bit_count() == 1:  # one variant, of each row that has any left
            stem, more = _stem(ARITHMETIC[every.bit_length() - 1])
            low, high = _range(stem, x0[0], x1[0], x0[1], x1[1])
            return ((x1[2] - low >= more) & (high - x0[2] >= -more)) * variants[:, None]
        left = np.zeros(x0.shape[1:], np.int32)
        for stem, members in STEMS.items():
            if not every & MASK[stem]:
                continue
            mine = (variants & MASK[stem]) != 0
            rows = slice(None) if mine.all() else np.flatnonzero(mine)
            low, high = _range(stem, x0[0, rows], x1[0, rows], x0[1, rows], x1[1, rows])
            out0, out1 = x0[2, rows], x1[2, rows]
            under, over = out1 - low, high - out0
            for r, more in members:
                if every >> r & 1:
                    left[rows] |= ((under >= more) & (over >= -more)).astype(np.int32) << np.int32(r)
        return left & variants[:, None]

    def narrow(self, puzzle: np.ndarray, domain: np.ndarray, variants: np.ndarray) -> np.ndarray:
        """Domains and variants of nodes, in place, to where nothing more leaves; whether all have something left."""
        alive = np.ones(len(puzzle), bool)
        waiting = np.arange(len(self.weight)) < self.sizes[puzzle][:, None]
        touched, there = self.touched[puzzle], self.there[puzzle]
        moving = np.arange(len(puzzle))
        while len(moving):
            # digits in use leave other domains
            before = d = domain[moving]
            while True:
                single = COUNT[d] == 1
                taken = np.bitwise_or.reduce(np.where(single, d, 0), axis=1)
                after = np.where(single, d, d & ~taken[:, None])
                alive[moving] &= (COUNT[taken] == single.sum(1)) & ((after != 0) | ~there[moving]).all(1)
                if (after == d).all():
                    break
                d = after
            domain[moving] = d
            moved = ((before != d) * BIT).sum(1).astype(np.int16)
            waiting[moving] |= (touched[moving] & moved[:, None]) != 0
            moving = moving[alive[moving] & waiting[moving].any(1)]
            for e in range(waiting.shape[1]):
                rows = moving[waiting[moving, e] & alive[moving]]
                if len(rows):
                    self._equation(e, rows, puzzle[rows], domain, variants, waiting, alive, touched)
            moving = moving[alive[moving]]
        return alive

    def _equation(self, e: int, rows: np.ndarray, p: np.ndarray, domain: np.ndarray, variants: np.ndarray, waiting: np.ndarray, alive: np.ndarray, touched: np.ndarray) -> None:
        waiting[rows, e] = False
        d, s = domain[rows], self.sign[p, e]
        low, high = LOW[d], HIGH[d]
        w, signed = self.weight[e], self.signed[e]
        each0, each1 = w[:, p] * low, w[:, p] * high
        if signed:  # only results are negative
            each0[2], each1[2] = np.minimum(each0[2], each1[2]), np.maximum(each0[2], each1[2])
        sum0, sum1 = each0.sum(2, dtype=np.int32), each1.sum(2, dtype=np.int32)
        had = variants[rows, s]
        left = self._meets(had, sum0[:, :, None], sum1[:, :, None])[:, 0]
        alive[rows] &= left != 0
        variants[rows, s] = left
        fewer = rows[left != had]
        if len(fewer):
            waiting[fewer] |= np.arange(waiting.shape[1]) < self.sizes[p[left != had]][:, None]
        r, c = np.nonzero(self.used[p, e] & (COUNT[d] > 1) & (left != 0)[:, None])
        if not len(r):
            return
        step = w[:, p[r], c][:, :, None] * DIGITS
        keep = self._meets(left[r], (sum0[:, r] - each0[:, r, c])[:, :, None] + step, (sum1[:, r] - each1[:, r, c])[:, :, None] + step) != 0
        kept = np.packbits(keep, axis=1, bitorder="little").view("<u2")[:, 0].astype(np.int16) & d[r, c]
        cut = kept != d[r, c]
        r, c, kept = r[cut], c[cut], kept[cut]
        domain[rows[r], c] = kept
        alive[rows[r[kept == 0]]] = False
        moved = np.zeros(len(rows), np.int16)
        np.bitwise_or.at(moved, r, BIT[c])
        waiting[rows] |= (touched[rows] & moved[:, None]) != 0


FAILED, WHOLE, OPEN = 0, 1, 2


def _solve(ciphers: list[Cipher], most: int, pool: int, short: int | None = None) -> list[tuple[int, bool]]:
    """Fills in nodes and found; with short, what nodes and whether anything is found are under that smaller budget, which is the same search cut off."""
    batch, n = Batch(ciphers), len(ciphers)
    early, early_found = np.full(n, -1), np.zeros(n, bool)
    budget, nodes, found = np.array([c.budget for c in ciphers]), np.zeros(n, np.int64), np.zeros(n, np.int64)
    # of each puzzle a path of nodes, and of each node all that branch off it: domains, variants, what became of them, and the digits to come
    domains, variants = np.zeros((n, 11, 10, 10), np.int16), np.zeros((n, 11, 10, batch.variants.shape[1]), np.int32)
    kind, rest, depth = np.zeros((n, 11, 10), np.int8), np.zeros((n, 11), np.int16), np.full(n, -1)

    def put(p: np.ndarray, digit: np.ndarray, domain: np.ndarray, left: np.ndarray) -> None:
        good = batch.narrow(p, domain, left)
        at = depth[p]
        domains[p, at, digit], variants[p, at, digit] = domain, left
        kind[p, at, digit] = np.where(good, np.where((COUNT[domain] > 1).any(1), OPEN, WHOLE), FAILED)

    def walk(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """On to the next node of each path that branches; puzzles and digits of these."""
        going, digits = [], []
        while len(p):
            spent = rest[p, depth[p]] == 0
            depth[p[spent]] -= 1
            p = p[depth[p] >= 0]
            q = p[rest[p, depth[p]] != 0]
            lowest = rest[q, depth[q]] & -rest[q, depth[q]]
            rest[q, depth[q]] ^= lowest
            digit = LOW[lowest]
            nodes[q] += 1
            what, within = kind[q, depth[q], digit], nodes[q] <= budget[q]
            if short is not None:
                # the first node beyond the smaller budget: what is found so far is within it
                first = q[nodes[q] == short + 1]
                early[first] = nodes[first] + (COUNT[rest[first]] * (np.arange(11) <= depth[first][:, None])).sum(1)
                early_found[first] = found[first] > 0
            for k in np.flatnonzero((what == WHOLE) & within):
                domain, left = domains[q[k], depth[q[k]], digit[k]], variants[q[k], depth[q[k]], digit[k]]
                ciphers[q[k]].found.append(({x: int(LOW[domain[i]]) for i, x in enumerate(batch.letters[q[k]])}, {op: ARITHMETIC[(int(left[i]) & -int(left[i])).bit_length() - 1] for i, op in enumerate(batch.signs[q[k]])}))
                found[q[k]] += 1
            # beyond the budget or with all found, what is left on the path is counted, not searched
            over = q[~within | (found[q] >= most)]
            nodes[over] += (COUNT[rest[over]] * (np.arange(11) <= depth[over][:, None])).sum(1)
            depth[over] = -1
            down = within & (what == OPEN) & (depth[q] >= 0)
            going.append(q[down])
            digits.append(digit[down])
            stays = np.ones(n, bool)
            stays[q[down]] = False
            p = p[(depth[p] >= 0) & stays[p]]
        return (np.concatenate(going), np.concatenate(digits)) if going else (p, p)

    queue, running = np.arange(n), np.arange(0)
    while len(queue) or len(running):
        new, queue = queue[: pool - len(running)], queue[pool - len(running) :]
        # the root is the one node that branches off the first level
        depth[new], rest[new, 0] = 0, 1
        if len(new):
            put(new, np.zeros(len(new), np.int64), batch.start[new], batch.variants[new])
        running, digit = walk(np.concatenate([new, running]))
        if len(running):
            domain, left = domains[running, depth[running], digit], variants[running, depth[running], digit]
            count = COUNT[domain]
            letter = np.where(count > 1, count, 11).argmin(1)
            depth[running] += 1
            rest[running, depth[running]] = domain[np.arange(len(running)), letter]
            r, digit = np.nonzero(rest[running, depth[running]][:, None] & BIT)
            domain, left = domain[r], left[r]
            domain[np.arange(len(r)), letter[r]] = BIT[digit]
            put(running[r], digit, domain, left)
    for c, k in zip(ciphers, nodes.tolist(), strict=True):
        c.nodes = k
    # a search that ends within the smaller budget is the same under both
    return list(zip(np.where(early < 0, nodes, early).tolist(), np.where(early < 0, found > 0, early_found).tolist(), strict=True))


def _alike(ciphers: list[Cipher], step: int, least: int = 1000) -> list[list[int]]:
    """Numbers of ciphers to be searched together, at most `step`: those of the same variants where they are `least` or more, so that a range is worked out for all rows or for none."""
    by: dict[frozenset, list[int]] = {}
    for k, c in enumerate(ciphers):
        by.setdefault(frozenset(v for vs in c.families.values() for v in vs), []).append(k)
    groups = [g for g in by.values() if len(g) >= least]
    groups.append([k for g in by.values() if len(g) < least for k in g])
    return [g[at : at + step] for g in groups for at in range(0, len(g), step)]


def solve_all(ciphers: list[Cipher], most: int = 2, step: int = 10_000, pool: int = 4000) -> list[Cipher]:
    """Cipher.solve of each, the nodes below `pool` nodes of as many puzzles at a time; what has no room in the arrays is solved alone."""
    together = []
    for c in ciphers:
        if has_room(c):
            c.nodes, c.found = 0, []
            together.append(c)
        else:
            c.solve(most)
    for some in _alike(together, step):
        _solve([together[k] for k in some], most, pool)
    return ciphers


def solve_under_both(ciphers: list[Cipher], short: int, most: int = 1, step: int = 10_000, pool: int = 4000) -> list[tuple[int, bool]]:
    """solve_all, and the nodes and whether anything is found under the smaller budget `short`, in one search."""
    rows: list = [None] * len(ciphers)
    together = [k for k, c in enumerate(ciphers) if has_room(c) and c.budget > short]
    for k in set(range(len(ciphers))) - set(together):
        c, budget = ciphers[k], ciphers[k].budget
        c.budget = short
        c.solve(most)
        rows[k] = (c.nodes, bool(c.found))
        c.budget = budget
        c.solve(most)
    for group in _alike([ciphers[k] for k in together], step):
        some = [together[k] for k in group]
        for k in some:
            ciphers[k].nodes, ciphers[k].found = 0, []
        for k, row in zip(some, _solve([ciphers[k] for k in some], most, pool, short), strict=True):
            rows[k] = row
    return rows


# fixpoints alone, letters by puzzles


def fixpoints(ciphers: list[Cipher]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Domains of letters (by letter and cipher) at the start and after narrowing, and whether all have something left; of ciphers that have room."""
    batch = Batch(ciphers)
    after = batch.start.copy()
    alive = batch.narrow(np.arange(len(ciphers)), after, batch.variants.copy())
    return np.ascontiguousarray(batch.start.T), np.ascontiguousarray(after.T), alive


def subset_cuts(domain: np.ndarray, there: np.ndarray, most: int = 5) -> np.ndarray:
    """solve.subset_cuts of many puzzles, in place: domain and there by letter and puzzle; values taken away from each puzzle."""
    cuts = np.zeros(domain.shape[1], np.int64)
    full = np.flatnonzero(there.all(0))

    def leave(rows: np.ndarray, stay: np.ndarray) -> None:
        had = domain[:, rows]
        cuts[rows] += COUNT[had & ~stay].sum(0)
        domain[:, rows] = had & stay

    for k in range(1, most + 1):
        for group in map(list, combinations(range(10), k)):
            union = np.bitwise_or.reduce(domain[group], axis=0)
            rows = np.flatnonzero((COUNT[union] == k) & there[group].all(0))
            if len(rows):
                stay = np.tile(~union[rows], (10, 1))
                stay[group] = -1
                leave(rows, stay)
        for values in combinations(range(10), k):
            mask = np.int16(sum(1 << v for v in values))
            has = (domain[:, full] & mask) != 0
            some = has.sum(0) == k
            if some.any():
                leave(full[some], np.where(has[:, some], mask, np.int16(-1)))
    return cuts


#: Puzzles whose sets of letters are looked at together.
SOME = 500


def _unions(domain: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set of letters (by mask and puzzle) the digits of its domains together, and how many letters it has."""
    union, size = np.zeros((1024, domain.shape[1]), np.int16), np.zeros((1024, domain.shape[1]), np.int8)
    for i in range(10):
        union[1 << i : 2 << i] = union[: 1 << i] | domain[i]
        size[1 << i : 2 << i] = size[: 1 << i] + there[i]
    return union, size


def matchable(domain: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Whether distinct digits can be drawn from all domains: by Hall, no set of letters has fewer."""
    found = [np.empty(0, bool)]
    for at in range(0, domain.shape[1], SOME):
        union, size = _unions(domain[:, at : at + SOME], there[:, at : at + SOME])
        found.append((np.bitwise_count(union).view(np.int8) >= size).all(0))
    return np.concatenate(found)


def hall_groups(domain: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of letters that leave no matching once set, counted, and the largest group that refutes one.

    solve.hall_violator stops at the first letter that can't be matched with those
    before it, and what its search reaches is the least set of these letters with
    too few digits: of the sets with too few, the one whose last letter comes first,
    and of these the smallest. A set that holds the letter set is never that one.
    """
    if domain.shape[1] > SOME:
        parts = [hall_groups(domain[:, at : at + SOME], there[:, at : at + SOME]) for at in range(0, domain.shape[1], SOME)]
        return tuple(map(np.concatenate, zip(*parts, strict=True)))
    union, size = _unions(domain, there)
    count = np.bitwise_count(union).view(np.int8)
    last = np.repeat(np.arange(11), [1, *(1 << i for i in range(10))])
    key = (last[:, None] * 16 + size).astype(np.uint8)
    refuted, largest = np.zeros((2, domain.shape[1]), np.int64)
    for v in range(10):
        few = count - ((union >> v) & 1).astype(np.int8) < size
        first = np.where(few, key, np.uint8(255))
        for x in range(10):
            least = first.reshape(512 >> x, 2, 1 << x, -1)[:, 0].min(axis=(0, 1))
            asked = ((domain[x] >> v & 1) == 1) & (least < 255)
            refuted += asked
            largest = np.maximum(largest, np.where(asked, least & 15, 0))
    return refuted, largest
