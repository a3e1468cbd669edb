"""Main text of HTML pages by composite text density.

Every block node of the DOM gets a density: its characters for each tag,
scaled down by its share of link text. A node's density sum adds up its
children's densities; the node with the largest sum holds the main text. The
least density on the way from it to the body is the threshold: nodes outside
it that reach the threshold are kept too. Where the best node lies in
an article or main element, the way ends at that element. Elements that are never article text
(menus, forms, scripts, ..) leave the DOM first, and so do parts whose class or
id names one of these, unless they hold most of the page; whatever else stands
in the article (formulas, drawings, lists of links, hidden parts) stays. Inline
elements belong to their block, links being counted.

Defined cases: null or empty html gives an empty text, like a page without any
main text; unclosed and unmatched tags close where HTML lets them; a page
without a body element is its own body; of equal density sums a node in
an article or main wins, then the deeper one; repeated pages are read each by itself; an empty table gives an empty
result; extra columns pass through when listed in `keep`.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import slices

# Fixed values of HTML: elements without content, with raw text, that are blocks, and that a start tag closes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes noscript xmp template".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - set("caption dd dt head html body tbody td tfoot th thead tr li option optgroup legend".split()) | {"dd", "dt", "li"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = set("html body table td th caption article section div ul ol dl main aside nav header footer form blockquote fieldset button".split())
# Fixed values of pages: what is never article text, by element, role, and word of a class or id.
NEVER = set("head script style noscript template nav footer aside form iframe embed button select textarea dialog menu noembed noframes search title".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HINTS = set("nav navbar navigation menu footer masthead sidebar ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup breadcrumb breadcrumbs pagination pager toolbar login paywall disclaimer".split())
COMMENTS = set("comment comments commentlist disqus".split())
HINTS |= set("replies responses discussion".split())
#: Elements that hold text of their own: inside an article no name alone makes them anything else.
TEXTUAL = set("h1 h2 h3 h4 h5 h6 p blockquote pre figure figcaption ul ol li dl dt dd table tr td th caption".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 p blockquote pre".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
SPACE = re.compile(r"\s+")


class Dom:
    """Nodes by number, parents before children; events are (node, None) at a start, (node, text) for text, (~node, None) at an end."""

    def __init__(self, page: str):
        self.tag, self.parent, self.attributes, self.events = ["#root"], [-1], [""], []
        stack, at, n = [0], 0, len(page)

        def close(depth: int) -> None:
            while len(stack) > depth:
                self.events.append((~stack.pop(), None))

        while at < n:
            m = TAG.search(page, at)
            if m is None:
                self.events.append((stack[-1], page[at:]))
                break
            if m.start() > at:
                self.events.append((stack[-1], page[at : m.start()]))
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                for depth in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[depth]] == name:
                        close(depth)
                        break
                    if name not in BLOCK and self.tag[stack[depth]] in BLOCK:
                        break  # an inline end tag doesn't reach out of its block
                    if name == "p" and self.tag[stack[depth]] in SCOPE:
                        break
                continue
            ends = {"p"} if name in CLOSES_P else set()
            ends |= SELF_CLOSING.get(name, set())
            if ends:
                for depth in range(len(stack) - 1, 0, -1):
                    tag = self.tag[stack[depth]]
                    if tag in ends:
                        close(depth)
                        if name not in SELF_CLOSING or tag in ("tr", "tbody", "thead"):
                            break
                    elif tag in SCOPE and not (tag in ("td", "th") and name in ("tr", "tbody", "tfoot")):
                        break
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.attributes.append(m[3] or m[6] or "")
            self.events.append((node, None))
            if name in VOID or (m[3] or "").endswith("/") and name not in BLOCK | RAW:
                self.events.append((~node, None))
            elif name in RAW:
                end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
                at = n if end is None else end.start()
                if end is not None:
                    at = page.find(">", at) + 1 or n
                self.events.append((~node, None))
            else:
                stack.append(node)
        close(0)


def _hinted(tag: str, attributes: str, in_article: bool) -> int:
    """What an element, its role, or its class and id say: 0: nothing; 1: a word of a name that it isn't article text; 2: a whole name; 3: it surely isn't."""
    if tag in NEVER or tag == "header" and not in_article:
        return 3
    if not attributes or tag in ("html", "body", "article", "main", "#root"):
        return 0
    level = 0
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role":
            level = 3 if value.lower() in ROLES else level
        else:
            for one in value.split():
                words = {w.lower() for w in WORDS.findall(one)}
                level = max(level, 3 if words & COMMENTS else 2 if one.lower() in HINTS else 1 if words & HINTS or "header" in words and not in_article else 0)
        if level == 3:
            return 3
    return level


def density(c: int, t: int, lc: int, lt: int, body_c: int, body_lc: int) -> float:
    """Composite text density: characters, tags, link characters and link tags of a node, and those of the body."""
    if not c:
        return 0.0
    t = max(t, 1)
    if not body_lc:
        return c / t
    base = math.log(c / max(c - lc, 1) * lc + body_lc / body_c * c + math.e)
    return c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / math.log(base) if base > 1 else c / t


def main_text(page: str | None) -> str:
    if not page or "<" not in page and not page.strip():
        return ""
    dom = Dom(page)
    tag, parent, n = dom.tag, dom.parent, len(dom.tag)
    block = [t in BLOCK or t == "#root" for t in tag]
    texts: list[tuple[int, str]] = [(i, entities.unescape(s)) for i, s in dom.events if s is not None]
    own = [0] * n
    for i, s in texts:
        own[i] += len("".join(s.split()))
    whole, links = own[:], [0] * n
    article, special = [False] * n, [False] * n
    for i in range(1, n):
        article[i] = article[parent[i]] or tag[i] in ("article", "main")
        special[i] = tag[i] in ("article", "main", "h1")
    for i in range(n - 1, 0, -1):
        links[i] = whole[i] if tag[i] == "a" else links[i]
        whole[parent[i]] += whole[i]
        links[parent[i]] += links[i]
        special[parent[i]] |= special[i]
    gone, linked = [False] * n, [False] * n
    for i in range(1, n):
        p = parent[i]
        level = 0 if gone[p] else _hinted(tag[i], dom.attributes[i], article[p])
        # a name is borne out by links, outside articles by being a small part; in an article a container's whole name will do
        mostly_links = 2 * links[i] >= whole[i]
        borne = mostly_links or (level == 2 and tag[i] not in TEXTUAL if article[p] else 2 * whole[i] <= whole[0])
        gone[i] = gone[p] or level == 3 or level > 0 and not special[i] and borne
        linked[i] = linked[p] or tag[i] == "a"
    c, t, lc, lt = ([0] * n for _ in range(4))
    for i in range(n):
        if not gone[i]:
            c[i] = own[i]
            lc[i] = own[i] if linked[i] else 0
    for i in range(n - 1, 0, -1):
        if not gone[i]:
            p = parent[i]
            c[p] += c[i]
            lc[p] += lc[i]
            t[p] += t[i] + block[i]
            lt[p] += lt[i] + (tag[i] == "a")
    body = next((i for i in range(n) if tag[i] == "body"), 0)
    if not c[body]:
        body = 0
    if not c[body]:
        return ""
    dense = [density(c[i], t[i], lc[i], lt[i], c[body], lc[body]) if block[i] and not gone[i] else 0.0 for i in range(n)]
    total, inside = [0.0] * n, [False] * n
    for i in range(body, n):
        inside[i] = i == body or parent[i] >= 0 and inside[parent[i]]
    up = parent[:]  # the nearest block above
    for i in range(1, n):
        if up[i] > 0 and not block[up[i]]:
            up[i] = up[up[i]]
        if block[i] and inside[i] and i != body:
            total[up[i]] += dense[i]
    nodes = [i for i in range(n) if inside[i] and block[i] and not gone[i]]
    # of equal sums the node of an article wins, then the deeper one
    best = max(nodes, key=lambda i: (total[i], article[i], i))
    path, i = [], best
    while i > 0 and i != body:
        path.append(i)
        i = parent[i]
    # the threshold is the least density on the way to the body; where the best node lies in an article, on the way to that
    marked = next((k for k in range(len(path) - 1, -1, -1) if tag[path[k]] in ("article", "main")), None)
    threshold = min([dense[i] for i in (path if marked is None else path[: marked + 1]) if block[i]] + [dense[body]] * (marked is None))
    # the best node may be a part of its article: the whole of that is kept. Where there's none, headings, paragraphs and
    # bare text beside the way up are, as long as what lies there isn't links
    root = next((i for i in path if tag[i] == "article" and dense[i]), next((i for i in path if tag[i] == "main" and dense[i]), None))
    climbed, bare, i = [False] * n, [False] * n, best
    while root is None and i > 0 and i != body:
        p = up[i]
        if p < 0 or gone[p] or 2 * (lc[p] - lc[i]) > c[p] - c[i] or not dense[p]:
            break
        climbed[p], i = True, p
    best = best if root is None else root
    chosen = [False] * n
    for i in range(n):
        p = parent[i]
        bare[i] = climbed[i] or not block[i] and p >= 0 and bare[p] and tag[i] != "a"
        beside = p >= 0 and (bare[p] or climbed[p]) and tag[i] in HEADINGS and 2 * lc[i] <= c[i]
        chosen[i] = i == best or p >= 0 and chosen[p] or beside or block[i] and inside[i] and not t[i] and dense[i] >= max(threshold, 1e-9)
    blocks, line = [], []

    def flush() -> None:
        if line:
            s = SPACE.sub(" ", entities.unescape("".join(line))).strip()
            if s:
                blocks.append(s)
            line.clear()

    for i, s in dom.events:
        k = i if i >= 0 else ~i
        if s is not None:
            if (chosen[k] or bare[k]) and not gone[k]:
                line.append(s)
        elif block[k]:
            flush()
        elif tag[k] == "br" and i >= 0:
            line.append(" ")
    flush()
    return "\n".join(blocks)


def extract(pages: DataFrame, keep: list[str], html: str = "html", out: str = "text") -> DataFrame:
    """The columns keep and the main text of every row of pages."""
    names = [f"c{i}" for i in range(len(keep))]
    source = pages.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(keep, names, strict=True)), F.col(f"`{html}`").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            *kept, pages_ = batch.columns
            yield pa.RecordBatch.from_arrays([*kept, pa.array([main_text(p) for p in pages_.to_pylist()], pa.string())], [*names, "t"])

    made = source.mapInArrow(run, source.select(*names).schema.add("t", "string"))
    return made.select(*(F.col(x).alias(c) for x, c in zip(names, keep, strict=True)), F.col("t").alias(out))
