"""What belongs to an article stays, whatever stands between it and its densest part."""

import pytest

from tracewright.llm import html

LONG = "A long paragraph, with words that go on and on and fill the line, so that its density is plain to see. " * 3
FRAME = "<html><body><nav><a href='/'>Home</a><a href='/b'>More</a></nav>%s<footer><a href='/c'>Contact</a> us</footer></body></html>"


def blocks(body):
    return html.main_text(FRAME % body).split("\n")


@pytest.mark.parametrize(("open_", "close"), [("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ("", ""), ("<div>", "</div>")])
def test_title_and_short_end_around_an_inner_div(open_, close):
    got = blocks(f"{open_}<h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p></div><p>Short end.</p>{close}")
    assert got == ["Title", LONG.strip(), LONG.strip(), "Short end."]


def test_bare_text_in_the_body_and_beside_a_div():
    assert blocks(f"Before <b>it</b> all <div><p>{LONG}</p><p>{LONG}</p></div> after it") == ["Before it all", LONG.strip(), LONG.strip(), "after it"]


@pytest.mark.parametrize("part", ['<p class="notice">%s</p>', '<p class="banner-year">%s</p>', '<p id="menu-history">%s</p>', '<ul class="ad hoc"><li>%s</li></ul>', '<section id="discussion"><p>%s</p></section>', '<div class="sponsored-study"><p>%s</p></div>', '<h2 class="promo">%s</h2>'])
@pytest.mark.parametrize("text", ["Short words here.", LONG.strip()])
def test_a_word_of_a_name_alone_drops_nothing_in_an_article(part, text):
    if 'id="discussion"' in part:
        part = part.replace('"discussion"', '"discussion-of-results"')
    assert blocks(f"<article><p>{LONG}</p>{part % text}<p>{LONG}</p></article>") == [LONG.strip(), text, LONG.strip()]


@pytest.mark.parametrize("part", ['<div class="ad">%s</div>', '<div class="cookie notice"><p>%s</p></div>', '<section class="comments"><p>%s</p></section>', "<ul class='menu'><li><a href='/'>%s</a></li></ul>", "<div class='related promo-links'><a href='/'>%s</a></div>", "<aside>%s</aside>", '<div role="dialog">%s</div>'])
def test_adverts_notices_menus_and_comments_go_from_an_article(part):
    assert blocks(f"<article><h1>Title</h1><p>{LONG}</p>{part % 'Buy this now, please.'}<p>End.</p></article>") == ["Title", LONG.strip(), "End."]


def test_menus_beside_the_text_stay_out_without_an_article():
    links = "".join(f"<li><a href='/{i}'>Link number {i}</a></li>" for i in range(20))
    assert blocks(f"<ul>{links}</ul><h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p></div><div><a href='/x'>One</a> <a href='/y'>Two</a></div>") == ["Title", LONG.strip(), LONG.strip()]
