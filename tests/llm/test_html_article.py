import time

import pytest
from conftest_llm import clashing

from cohortlens.llm import html_article as H

PAGE = """<!doctype html><html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body class="page with-sidebar">
<header class="site-header"><a href="/">Home</a> <p>Slogan</p></header><div class="cookie-notice">We use cookies, ok, fine, yes?</div>
<main><article class="post"><header><h1>Head &amp; line</h1></header><!-- <p>gone</p> --><p>First&nbsp;paragraph, with <a href="x">a link</a>,
and   more<br>text that is long enough, yes.<p>Second <b>one</b> &lt;here&gt;.<ul><li>item one<li>item two</ul><div class="advert">Buy now, buy it</div>
<pre>code  x</pre><aside>aside</aside><table><tr><td>a<td>b</table><div hidden>hid</div><form><input value=1>Send <button>Go</button></form>
<div class="share"><a href=1>f</a><a href=2>t</a></div></article>
<section id="comments"><article class="comment"><p>Nice post, thanks, a lot, of commas, here, I say, really long, comment, more.</p></article></section></main>
<div class="sidebar"><p>Side, text, with, commas, and, length, going, on, for, a, while, here.</p></div><footer>(c) 2020</footer></body></html>"""


def test_article_and_nothing_else():
    assert H.article(PAGE).split("\n") == ["Head & line", "First paragraph, with a link, and more text that is long enough, yes.", "Second one <here>.",
                                           "item one", "item two", "code x", "a", "b"]


def test_without_an_article_element():
    body = "".join(f"<p>Sentence {k}, with words, and commas, that go on for some time here.</p>" for k in range(6))
    links = "".join(f'<li><a href="{k}">link {k}</a></li>' for k in range(20))
    page = f'<div><ul>{links}</ul></div><div><h2>Top</h2>{body}</div><div><p>Tiny.</p></div>'
    assert H.article(page).split("\n") == ["Top", *(f"Sentence {k}, with words, and commas, that go on for some time here." for k in range(6))]


def test_lenient_reading():
    assert H.article("") == "" and H.article("<p></p>") == "" and H.article("<script>x") == ""
    assert H.article("just  text\nno markup") == "just text no markup"
    assert H.article("<p>a < b</p></div></b>") == "a < b"
    assert H.article("<div>" * 30_000 + "deep") == "deep"
    assert H.article("<p>" + "long, " * 50_000 + "</p>").count("long") == 50_000


def test_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "<p>x &eacute;</p>")]
    found = H.extract(clashing(spark, rows, "page_id long, url string, html string")).collect()
    assert sorted(((r.page_id or 0, r.url or "", r.text[:6], r.n_chars) for r in found)) == [
        (0, "v", "x é", 3), (1, "u", "Head &", len(H.article(PAGE))), (1, "u", "Head &", len(H.article(PAGE))), (2, "", "", 0)]
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


SAID = [f"Sentence {k}, with words, and commas, that go on for some time here." for k in range(5)]
BODY = "<h2>Top</h2>" + "".join(f"<p>{x}</p>" for x in SAID)
AROUND = '<header class="top"><a href="/">Home</a></header>{}<div class="footer">(c) all rights</div>'


@pytest.mark.parametrize("wrapper", ['<div class="has-sidebar">{}</div>', '<div id="page-with-banner">{}</div>', '<form action="x">{}</form>', '<article class="post has-menu">{}</article>',
                                     '<article class="post widget-area">{}</article>', '<form><article>{}</article></form>', '<div class="nav-open menu"><div>{}</div></div>'])
def test_wrappers_named_after_what_they_hold(wrapper):
    for page in (wrapper.format(BODY), AROUND.format(wrapper.format(BODY + '<div class="sidebar"><p>Side text, by the way.</p></div>'))):
        assert H.article(page).split("\n") == ["Top", *SAID]


def test_long_comments_sidebars_and_forms_still_go():
    long = "".join(f"<p>Comment {k}, long, and with commas, and more of it than the article has.</p>" for k in range(40))
    for other in ('<div id="comments">{}</div>', '<section class="comment-list sidebar">{}</section>', '<article class="comment">{}</article>'):
        assert H.article(f"<div>{BODY}</div>" + other.format(long)).split("\n") == ["Top", *SAID]
    for other in ('<div class="sidebar">{}</div>', "<form>{}</form>", '<article class="related">{}</article>'):
        assert H.article(f"<main>{BODY}</main>" + other.format(long)).split("\n") == ["Top", *SAID]


@pytest.mark.parametrize("piece", ["<b ", "<b x='", '<a href="', "<head>", "<", "<!", "</p "])
def test_time_is_linear_in_unclosed_tags(piece):
    began = time.perf_counter()
    H.article(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 5
