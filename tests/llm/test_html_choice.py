"""The main text is chosen among all blocks, article elements or not."""

import pytest
from pyspark.sql import functions as F

from tracewright.llm import html

TEXT = [f"Paragraph {i} has a good number of words in it, so that it is text." for i in range(6)]
PARTS = [f"<p>{t}</p>" for t in TEXT]
TEASER = "<article><p>Short teaser</p></article>"


@pytest.mark.parametrize("page", [f"<body>{TEASER}<div class=content>{''.join(PARTS)}</div>{TEASER}</body>", "<body>" + "".join(f"<article>{a}{b}</article>" for a, b in zip(PARTS[::2], PARTS[1::2])) + "</body>", "<body><main>" + "".join(f"<article>{a}{b}</article>" for a, b in zip(PARTS[::2], PARTS[1::2])) + "</main></body>", f"<body><div>{''.join(PARTS)}</div></body>"])
def test_no_text_is_lost(page):
    got = html.main_text(page).split("\n")
    assert [t for t in got if t in TEXT] == TEXT


def test_nothing_else_is_dropped():
    parts = ["<p class=social>Social matters</p>", "<p>Area <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", "<svg><text>Axis</text></svg>", "<p hidden>Folded part</p>", "<p aria-hidden=true>For the eye</p>", "<ul class=related><li><a href=1>One</a><li><a href=2>Two</a></ul>", "<object>Plain form</object>"]
    page = f"<body><nav>Menu</nav><article>{PARTS[0]}{''.join(parts)}{PARTS[1]}</article><aside>Side</aside></body>"
    assert html.main_text(page).split("\n") == [TEXT[0], "Social matters", "Area x=2 holds", "Axis", "Folded part", "For the eye", "One", "Two", "Plain form", TEXT[1]]


LINKS = "".join(f"<p><a href={i}>A long line of text that is a link to page {i} of this site and no article</a></p>" for i in range(9))


@pytest.mark.parametrize("tag", ["div", "article", "section"])
def test_links_lose_though_they_are_longer(monkeypatch, tag):
    page = f"<body><div>{LINKS}</div><{tag}>{''.join(PARTS)}</{tag}><div>{LINKS}</div></body>"
    assert html.main_text(page).split("\n") == TEXT
    monkeypatch.setattr(html, "density", lambda *a: 0.0)
    assert html.main_text(page).split("\n") != TEXT


@pytest.mark.parametrize("tag", ["div", "article", "section"])
def test_link_share_decides(monkeypatch, tag):
    """Without the adjustment for links the longer part wins."""
    page = f"<body><div>{LINKS}</div><{tag}>{''.join(PARTS)}</{tag}></body>"
    assert html.main_text(page).split("\n") == TEXT
    monkeypatch.setattr(html, "density", lambda c, t, *a: c / max(t, 1))
    assert html.main_text(page).split("\n") != TEXT


def test_tables_of_pages(spark):
    long = "<article>" + "".join(f"<p>Line {i} of a very long page, &amp; more</p>" for i in range(60_000)) + "</article>"
    rows = [(1, "u", long), (2, "u", "<article><p>x y</p></article>"), (2, "u", "<article><p>x y</p></article>"), (None, None, None), (4, None, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("h", F.lit(1)).withColumn("c0", F.lit(2))
    got = [tuple(r) for r in html.extract(df, ["page_id", "url"]).collect()]
    assert [g for g in got if g[0] != 1] == [(2, "u", "x y"), (2, "u", "x y"), (None, None, ""), (4, None, "")]
    assert got[0][2].split("\n") == [f"Line {i} of a very long page, & more" for i in range(60_000)]
    assert html.extract(df.limit(0), ["page_id"]).count() == 0
