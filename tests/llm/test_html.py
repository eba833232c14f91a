"""Main text of pages written by hand, with names and shapes that no generated page has."""

import time

import pytest

from voxelia.llm import html_blocks

STORY = ["The harbour opens again", "Ships returned to the harbour this morning after a week of storms.", "The first to enter was a small ferry, and many people had come to see it."]
BODY = f"<h1>{STORY[0]}</h1><p>{STORY[1]}</p><p>{STORY[2]}</p>"
PAGES = {
    "thread in a section": f"<body><main>{BODY}</main><section id=disqus><p>I think this is great.</p><p>No, it is not.</p></section>",
    "dialog": f'<div role=dialog class=gdpr-banner><p>We use cookies to improve your visit.</p></div><article>{BODY}</article>',
    "signup and nested comments": f'<div class="newsletter-signup"><p>Sign up for our newsletter</p></div><article>{BODY}</article><div id="comments"><article class="comment"><p>Nice read</p></article></div>',
    "links without a name": f'<div><ul><li><a href="/">Start</a></li><li><a href="/a">Region</a></li><li><a href="/b">Weather</a></li></ul></div><div class="story">{BODY}</div><footer><p>Copyright of the paper</p></footer>',
    "roles": f'<div role="navigation"><a href="/">Home</a></div><div role="main">{BODY}</div><div role="contentinfo"><p>All rights reserved</p></div>',
    "advert inside": f'<article><h1>{STORY[0]}</h1><p>{STORY[1]}</p><div class="ad-slot"><p>Advertisement</p></div><p>{STORY[2]}</p></article>',
    "modal element": f"<dialog open><p>Accept all cookies?</p><button>Accept</button></dialog><main><article>{BODY}</article></main>",
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_by_hand(name):
    assert html_blocks.main_texts(html_blocks.trained(), [PAGES[name]])[0].split("\n") == STORY


def test_lists_and_tables_are_content():
    page = "<main><h1>Words</h1><dl><dt>Tree</dt><dd><p>A tall plant with a trunk of wood.</p></dd><dt>Bush</dt><dd>A small one.</dd></dl><table><tr><td>Oak</td><td>30 m</td></tr></table></main>"
    assert html_blocks.main_texts(html_blocks.trained(), [page])[0].split("\n") == ["Words", "Tree", "A tall plant with a trunk of wood.", "Bush", "A small one.", "Oak", "30 m"]


def test_words_that_repeat_weigh_once():
    (a,), (b,) = (html_blocks.features([(["p"], t, 0.0)])[1] for t in ("reply one", "reply " * 300 + "one"))
    assert sorted(a) == sorted(b)


def test_deep_pages_in_linear_time():
    began = time.time()
    assert len(html_blocks.blocks("<div>" * 40_000 + "x" + "</div>" * 40_000)) == 1
    assert len(html_blocks.blocks("".join(f"<div>w{k}" for k in range(40_000)))) == 40_000
    assert time.time() - began < 10


def test_paths_end_with_their_elements():
    found = html_blocks.blocks('<div class="a b-c"><p>one</p><div class="a"><p>two</p></div></div><p>three')
    assert found[0][0] == ["div", "div.a", "div.b-c", "~a", "~b", "~c", "p"] and set(found[1][0]) == set(found[0][0]) and found[2][0] == ["p"]
