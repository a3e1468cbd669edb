"""Solvers: relational where a puzzle's candidates are a table, search inside a row where they are a tree."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Variants of each operator family, in the order in which they are tried.
FAMILIES = {
    "mul": ["mul", "mul_p1", "mul_m1", "mul_p2", "mul_m2"],
    "add": ["add", "add_p1", "add_m1", "add_p2", "add_m2"],
    "sub": ["absdiff", "sub_signed", "neg_absdiff", "rsub_signed", "sub_signed_p1", "sub_signed_m1", "sub_signed_p2", "sub_signed_m2"],
}
VARIANTS = [v for vs in FAMILIES.values() for v in vs]
OFFSET = {"p1": 1, "m1": -1, "p2": 2, "m2": -2}


@cache
def _stem(variant: str) -> tuple[str, int]:
    stem, _, tail = variant.rpartition("_")
    return (stem, OFFSET[tail]) if tail in OFFSET else (variant, 0)


VALUE = {"mul": lambda a, b, absolute: a * b, "add": lambda a, b, absolute: a + b, "absdiff": lambda a, b, absolute: absolute(a - b), "neg_absdiff": lambda a, b, absolute: -absolute(a - b), "sub_signed": lambda a, b, absolute: a - b, "rsub_signed": lambda a, b, absolute: b - a}


def apply(variant: str, a: Column, b: Column) -> Column:
    stem, more = _stem(variant)
    return VALUE[stem](a, b, F.abs) + F.lit(more)


def number(variant: str, a: int, b: int) -> int:
    stem, more = _stem(variant)
    return VALUE[stem](a, b, abs) + more


def consistent_variants(examples: DataFrame, keys: list[str]) -> DataFrame:
    """keys and `variants`: those that reproduce every example (a, b, out) of the key, in the order of trial. Relational division as one aggregate."""
    fits = [F.every(apply(v, F.col("a"), F.col("b")) == F.col("out")).alias(v) for v in VARIANTS]
    g = examples.groupBy(*keys).agg(*fits)
    return g.select(*keys, F.array_compact(F.array(*(F.when(F.col(v), F.lit(v)) for v in VARIANTS))).alias("variants"))


def family(variant: Column) -> Column:
    return F.when(F.startswith(variant, F.lit("mul")), "mul").when(F.startswith(variant, F.lit("add")), "add").when(variant.isNotNull(), "sub")


def possible_families(digits: Column) -> Column:
    """Families that can give a result of so many digits from two-digit operands."""
    arr = lambda *x: F.array(*map(F.lit, x))
    return F.when(digits <= 1, arr("sub")).when(digits == 2, arr("add", "sub")).when(digits == 3, arr("add", "mul")).otherwise(arr("mul"))


def family_ranking(counts: Column) -> Column:
    """Families that can give all the counts, likeliest first; all of them where none can."""
    order = F.array(*map(F.lit, ["add", "sub", "mul"]))
    left = F.aggregate(counts, order, lambda acc, d: F.array_intersect(acc, possible_families(d)))
    return F.when(F.size(left) == 0, order).otherwise(left)


def interval(kind: str, a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """Least and greatest result of a family for operands in two intervals of natural numbers, noise included."""
    if kind == "mul":
        return a[0] * b[0] - 2, a[1] * b[1] + 2
    if kind == "add":
        return a[0] + b[0] - 2, a[1] + b[1] + 2
    return F.least(a[0] - b[1], b[0] - a[1]) - 2, F.greatest(a[1] - b[0], b[1] - a[0]) + 2


# bytes

#: Names and expressions of one byte x: rotations, shifts with either fill, and their complements.
SHIFTS = ["id"] + [f"{n}{k}{f}" for k in range(1, 8) for n, f in (("rotl", ""), ("rotr", ""), ("shl", "f0"), ("shr", "f0"), ("shl", "f1"), ("shr", "f1"))]
UNARY = SHIFTS + [f"not_{s}" for s in SHIFTS]


def unary(name: str, x: Column) -> Column:
    if name.startswith("not_"):
        return F.lit(255) - unary(name[4:], x)
    if name == "id":
        return x
    kind, k, fill = name[:-1] if name[:3] == "rot" else name[:3], int(name[4] if name[:3] == "rot" else name[3]), name[-1]
    left, right = F.shiftleft(x, k).bitwiseAND(F.lit(255)), F.shiftright(x, k)
    if kind == "rotl":
        return left.bitwiseOR(F.shiftright(x, 8 - k))
    if kind == "rotr":
        return right.bitwiseOR(F.shiftleft(x, 8 - k).bitwiseAND(F.lit(255)))
    if kind == "shl":
        return left if fill == "0" else left.bitwiseOR(F.lit((1 << k) - 1))
    return right if fill == "0" else right.bitwiseOR(F.lit(255 & ~(255 >> k)))


def unary_number(name: str, x: int) -> int:
    if name.startswith("not_"):
        return 255 ^ unary_number(name[4:], x)
    if name == "id":
        return x
    k = int(name[4] if name[:3] == "rot" else name[3])
    left, right = x << k & 255, x >> k
    if name[:4] == "rotl":
        return left | x >> (8 - k)
    if name[:4] == "rotr":
        return right | x << (8 - k) & 255
    if name[:3] == "shl":
        return left | ((1 << k) - 1 if name[-1] == "1" else 0)
    return right | (255 & ~(255 >> k) if name[-1] == "1" else 0)


def unary_rules(examples: DataFrame, key: str) -> DataFrame:
    """key and the unary rules that reproduce every example (x, y), in order: one aggregate, 86 conditions."""
    g = examples.groupBy(key).agg(*(F.every(unary(n, F.col("x")) == F.col("y")).alias(n) for n in UNARY))
    return g.select(key, F.array_compact(F.array(*(F.when(F.col(n), F.lit(n)) for n in UNARY))).alias("rules"))


# ciphered equations


@dataclass
class Cipher:
    """Equations (a, op, b, out) of letters, one digit each, all different; a negative out has a minus in front. Signs are known by family; the variant is found."""

    equations: list[tuple[str, str, str, str]]
    families: dict[str, list[str]]
    little_endian: bool = False
    budget: int = 200_000
    nodes: int = 0
    found: list[tuple[dict[str, int], dict[str, str]]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.weights = []  # of each equation's three numbers: place values by letter
        for a, _, b, out in self.equations:
            self.weights.append([self._places(w) for w in (a, b, out)])

    def _places(self, word: str) -> dict[str, int]:
        places: dict[str, int] = {}
        sign, word = (-1, word[1:]) if word.startswith("-") else (1, word)
        for i, c in enumerate(word if self.little_endian else reversed(word)):
            places[c] = places.get(c, 0) + sign * 10**i
        return places

    @staticmethod
    def _bounds(places: dict[str, int], low: dict[str, int], high: dict[str, int]) -> tuple[int, int]:
        return sum(p * (low if p > 0 else high)[c] for c, p in places.items()), sum(p * (high if p > 0 else low)[c] for c, p in places.items())

    @staticmethod
    def _range(variant: str, a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
        stem, more = _stem(variant)
        if stem == "mul":
            low, high = a[0] * b[0], a[1] * b[1]
        elif stem == "add":
            low, high = a[0] + b[0], a[1] + b[1]
        else:
            low, high = a[0] - b[1], a[1] - b[0]
            if stem == "rsub_signed":
                low, high = -high, -low
            elif stem != "sub_signed":
                top = max(abs(low), abs(high))
                low, high = 0 if low <= 0 <= high else min(abs(low), abs(high)), top
                if stem == "neg_absdiff":
                    low, high = -high, -low
        return low + more, high + more

    def _meets(self, variants: list[str], x: tuple[int, int], y: tuple[int, int], z: tuple[int, int]) -> list[str]:
        found = []
        for v in variants:
            low, high = self._range(v, x, y)
            if low <= z[1] and z[0] <= high:
                found.append(v)
        return found

    def _propagate(self, domain: dict[str, set[int]], variants: dict[str, list[str]]) -> bool:
        """To a fixpoint: digits in use leave other domains, values that no variant can meet leave theirs, variants that meet no value leave."""
        changed = True
        while changed:
            changed = False
            for c, d in domain.items():
                if len(d) == 1:
                    for other, e in domain.items():
                        if other != c and d & e:
                            domain[other] = e - d
                            changed = True
                            if not domain[other]:
                                return False
            for (_, op, _, _), words in zip(self.equations, self.weights, strict=True):
                low, high = {c: min(d) for c, d in domain.items()}, {c: max(d) for c, d in domain.items()}
                bounds = [self._bounds(w, low, high) for w in words]
                left = self._meets(variants[op], *bounds)
                if not left:
                    return False
                if left != variants[op]:
                    variants[op], changed = left, True
                for c in {c for w in words for c in w}:
                    if len(domain[c]) == 1:
                        continue
                    share = [w.get(c, 0) for w in words]
                    rest = [(b[0] - p * (low if p > 0 else high)[c], b[1] - p * (high if p > 0 else low)[c]) for b, p in zip(bounds, share, strict=True)]
                    keep = {v for v in domain[c] if self._meets(left, *((r[0] + p * v, r[1] + p * v) for r, p in zip(rest, share, strict=True)))}
                    if not keep:
                        return False
                    if keep != domain[c]:
                        domain[c], changed = keep, True
        return True

    def _search(self, domain: dict[str, set[int]], variants: dict[str, list[str]], most: int) -> None:
        self.nodes += 1
        if self.nodes > self.budget or len(self.found) >= most or not self._propagate(domain, variants):
            return
        open_ = [c for c in domain if len(domain[c]) > 1]
        if open_:
            c = min(open_, key=lambda c: (len(domain[c]), c))
            for v in sorted(domain[c]):
                self._search({k: set(d) for k, d in domain.items()} | {c: {v}}, {k: list(x) for k, x in variants.items()}, most)
            return
        self.found.append(({c: next(iter(d)) for c, d in domain.items()}, {op: v[0] for op, v in variants.items()}))

    def letters(self) -> list[str]:
        return sorted({c for e in self.equations for w in (e[0], e[2], e[3]) for c in w.lstrip("-")})

    def start(self) -> dict[str, set[int]]:
        """Digits that each letter may be: not 0 where a number of several digits begins with it."""
        words = [w.lstrip("-") for e in self.equations for w in (e[0], e[2], e[3])]
        first = {(w[-1] if self.little_endian else w[0]) for w in words if len(w) > 1}
        return {c: set(range(1 if c in first else 0, 10)) for c in self.letters()}

    def solve(self, most: int = 2) -> list[tuple[dict[str, int], dict[str, str]]]:
        """Up to `most` assignments with the first variant of each sign; fewer than there are only beyond the budget of nodes."""
        domain = self.start()
        self.nodes, self.found = 0, []
        if len(domain) <= 10:
            self._search(domain, {k: list(v) for k, v in self.families.items()}, most)
        return self.found


def audit_claims(text: str) -> tuple[int, int]:
    """(claims, wrong ones): every `value = a op b` in a trace, worked out again."""
    import re

    claims = wrong = 0
    for m in re.finditer(r"(-?\d+) = (\d+) ?([+\-*×]) ?(\d+)(?: ?([+-]) ?(\d+))?", text):
        value = number({"+": "add", "-": "sub_signed"}.get(m[3], "mul"), int(m[2]), int(m[4]))
        value += int((m[5] or "+") + (m[6] or "0"))
        claims += 1
        wrong += value != int(m[1])
    return claims, wrong


def hall_violator(domains: list[set[int]]) -> set[int] | None:
    """Positions whose domains together hold fewer values than they are; None where distinct values can be drawn from all.

    A matching by augmenting paths: where one can't be grown, the positions that
    its search reached share too few values.
    """
    owner: dict[int, int] = {}
    for i in range(len(domains)):
        reached, came, queue, free = {i}, {}, [i], None
        while queue and free is None:
            k = queue.pop(0)
            for v in domains[k]:
                if v in came:
                    continue
                came[v] = k
                if v not in owner:
                    free = v
                    break
                if owner[v] not in reached:
                    reached.add(owner[v])
                    queue.append(owner[v])
        if free is None:
            return reached
        while free is not None:
            k = came[free]
            before = next((v for v, o in owner.items() if o == k), None)
            owner[free] = k
            free = None if k == i else before
    return None


def all_different(domains: list[set[int]]) -> bool:
    return hall_violator(domains) is None


def subset_cuts(domains: dict[str, set[int]], most: int = 5) -> int:
    """Values that naked subsets (k letters with k values: no other letter has them) and, where letters are as many as digits, hidden ones (k values in k letters: these have no others) take away, in place."""
    from itertools import combinations

    cuts = 0
    for k in range(1, most + 1):
        for group in combinations(sorted(domains), k):
            union = set().union(*(domains[c] for c in group))
            if len(union) == k:
                for c in set(domains) - set(group):
                    cuts += len(domains[c] & union)
                    domains[c] -= union
        if len(domains) == 10:
            for values in map(set, combinations(range(10), k)):
                group = [c for c in domains if domains[c] & values]
                if len(group) == k:
                    for c in group:
                        cuts += len(domains[c] - values)
                        domains[c] &= values
    return cuts
