"""Density sums as a plain recursion over random trees: the chosen node's text is what comes out."""

import math
import random

from tracewright.llm import html

BLOCKS, INLINE = ["div", "section", "ul", "li", "p"], ["a", "b", "span"]


def some_page(rng, depth=0):
    """Nested elements without names; (tag, children), texts are strings without blanks at their ends."""
    out = []
    for _ in range(rng.randrange(1, 5)):
        x = rng.random()
        if depth > 3 or x < 0.3:
            out.append(" ".join(f"w{rng.randrange(10**rng.randrange(1, 7))}" for _ in range(rng.randrange(1, 12))))
        elif x < 0.5:
            out.append((rng.choice(INLINE), [" ".join(f"i{rng.randrange(1000)}" for _ in range(rng.randrange(1, 5)))]))
        else:
            out.append((rng.choice(["div", "section"]), some_page(rng, depth + 1)))
    return out


def shown(node):
    return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(shown, node[1]))}</{node[0]}>"


def letters(node):
    return len("".join(node.split())) if isinstance(node, str) else sum(map(letters, node[1]))


def links(node, inside=False):
    if isinstance(node, str):
        return letters(node) if inside else 0
    return sum(links(x, inside or node[0] == "a") for x in node[1])


def tags(node, which):
    return 0 if isinstance(node, str) else sum(tags(x, which) + (not isinstance(x, str) and which(x[0])) for x in node[1])


def blocks_below(node):
    """The nearest blocks under a node."""
    found = []
    for x in node[1]:
        if not isinstance(x, str):
            found += [x] if x[0] in html.BLOCK else blocks_below(x)
    return found


def density(node, body):
    c, t, lc, lt = letters(node), max(1, tags(node, lambda x: x in html.BLOCK)), links(node), tags(node, lambda x: x == "a")
    if not c:
        return 0.0
    if not links(body):
        return c / t
    base = math.log(c / max(c - lc, 1) * lc + links(body) / letters(body) * c + math.e)
    return c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / math.log(base) if base > 1 else c / t


def every(node):
    return [] if isinstance(node, str) else [node, *(y for x in node[1] for y in every(x))]


def words(node):
    return node.split() if isinstance(node, str) else [w for x in node[1] for w in words(x)]


def test_the_node_of_the_largest_sum_is_kept_whole():
    rng, sole = random.Random(3), 0
    for _ in range(400):
        body = ("body", some_page(rng))
        sums = [(sum(density(x, body) for x in blocks_below(n)), i, n) for i, n in enumerate(every(body)) if n[0] in html.BLOCK]
        best = max(sums, key=lambda x: x[:2])
        if sum(abs(s[0] - best[0]) < 1e-9 * max(1, best[0]) for s in sums) > 1:
            continue  # rounding could settle a tie either way
        sole += 1
        got = html.main_text(f"<html>{shown(body)}</html>").split()
        kept = words(best[2])
        # the subtree's words stand there in their order, one after the other as far as other blocks allow
        at = iter(got)
        assert all(w in at for w in "".join(f" {w}" for w in kept).split()) or "".join(kept) in "".join(got)
    assert sole > 200
