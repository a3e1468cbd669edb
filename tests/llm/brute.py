"""Brute-force forms that several tests hold the operators against."""

def shingle_set(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_kept(texts):
    """Positions of the least id of each component; texts are (id, text) in order of id."""
    sets, parent = [shingle_set(t) for _, t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [i for i in range(len(texts)) if root(i) == i]


def slow_targets(sizes, weights=(5, 2, 1), repeats=3):
    """Words for each source, from {source: words}: one source at a time stops, the one furthest above its bound first."""
    from fractions import Fraction

    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, left, open_ = {}, Fraction(sum(sizes.values())), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        worst = max(open_, key=lambda s: share[s] - repeats * sizes[s])
        if share[worst] <= repeats * sizes[worst]:
            goal.update(share)
            break
        goal[worst] = Fraction(repeats * sizes[worst])
        left -= goal[worst]
        open_.remove(worst)
    return {s: float(g) for s, g in goal.items()}
