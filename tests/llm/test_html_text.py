import re

import pytest

from staylens.llm import html_text as H
from staylens.llm.html_text import main_text

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="with-sidebar"><header><h1>Site</h1></header>
<div id="cookie-notice">Cookies!</div><nav><ul><li>a<li>b</ul></nav><div class="sidebar"><p>side</p></div>
<main><article class="post has-comments"><header><h2>Title here</h2><p>By me</p></header><!-- <p>no</p> -->
<p>One &amp; two<br>three&nbsp;x &lt;b&gt;.</p><div class="ad">Buy</div><aside>side</aside><form>f<input></form>
<script>var t="</p>";</script><p>Short.<ul><li>item 1<li>item 2</ul><section class="comments"><p>first!</p></section>
</article></main><footer>foot"""


@pytest.mark.parametrize("page,text", [
    ("", ""), ("plain", "plain"), ("<p>unclosed <b>x", "unclosed x"), ("<div></div>", ""),
    ("a < b and <3 <p class='x>y'>hello", "a < b and <3\nhello"),
    ("<article><p>a</p><p>&#233;&copy;</p></article><p>" + "outside " * 50, "a\né©"),
    ("<article><p>x<article class=comment>c</article></article>", "x"),
    ("<script>never closed <p>x", ""), ("<article><p>a<!-- open <p>b", "a"),
    (PAGE, "Title here\nOne & two three x <b>.\nShort.\nitem 1\nitem 2"),
])
def test_pages(page, text):
    assert H.main_text(page) == text


def test_unmarked_page_by_distribution():
    body = "".join(f"<p>{'long text ' * 20}{i}</p>" for i in range(5)) + "<p>short</p>" + f"<p>{'more text ' * 20}</p>"
    page = "<body>" + "<p>x</p>" * 5 + body + "<p>y</p>" * 5 + "</body>"
    lines = H.main_text(page).split("\n")
    assert "short" in lines and len([x for x in lines if len(x) > 50]) == 6
    assert lines.count("x") <= 1 and lines.count("y") <= 1  # the window's edge


def test_surge_and_dive():
    assert H.surge_and_dive([0, 0, 200, 0, 0, 0, 300, 0], 120) == (1, 8)
    assert H.surge_and_dive([1, 2], 120) == (0, 0) and H.surge_and_dive([], 0) == (0, 0)


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", None), (2, "u", PAGE), (2, "u", PAGE), (None, None, "<p>" + "é " * 200_000)],
                               "page_id bigint, url string, html string").selectExpr("*", "7 as text", "8 as main_")
    out, c = H.extract(df)
    got = {r["page_id"]: r[c] for r in out.collect()}
    assert got[1]["text"] == "" and got[1]["n_chars"] == 0 and got[2]["n_lines"] == 5
    assert got[None]["n_chars"] == 399_999 and out.count() == 4
    assert H.extract(df.where("false"))[0].count() == 0


BODY = "<p>" + "The article says a lot here. " * 10 + "</p>"
KEPT = ("The article says a lot here. " * 10).strip()


@pytest.mark.parametrize("page", [
    f'<div class="content-with-sidebar"><article>{BODY}</article><div class="sidebar"><p>side</p></div></div>',
    f'<div class="elementor-widget elementor-widget-theme-post-content">{BODY}</div>',
    f'<main><div class="layout-search"><article>{BODY}</article></div></main>',
    f'<div id="page-header-fixed">{BODY}</div><div class="footer">end</div>',
    f'<article><div class="post-content widget">{BODY}</div><div class="related-content"><p>teaser</p></div></article>',
    f'<article>{BODY}</article><div class="sidebar"><article><p>teaser</p></article></div>',
    f'<article>{BODY}<section class="comments"><div class="content">{BODY}</div></section></article>',
])
def test_layout_wrappers_are_no_noise(page):
    assert H.main_text(page) == KEPT


def test_math_text_stays():
    page = ("<article><p>So <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation encoding='tex'>E=m</annotation></math> holds.</p>"
            "</article>")
    assert H.main_text(page) == "So E=m holds."


@pytest.mark.parametrize("page,text", [
    ("<article><p>long one here</p></article><p>out</p><article><p>two</p></article>", "long one here\ntwo"),
    ("<main><p>out</p><article><p>one</p></article><div class=content><p>two</p></div></main>", "one\ntwo"),
    ("<div class=post><p>one</p></div><nav>n</nav><div class=post><p>two</p><div class=entry>three</div></div>", "one\ntwo\nthree"),
    ("<div class=content><p>out</p><main><p>one</p><article>two<div class=content>three</div></article></main></div>", "two\nthree"),
])
def test_all_marked_containers(page, text):
    assert H.main_text(page) == text


LONG = "A paragraph of some length that belongs to the article of this page, as any reader can see at once."


@pytest.mark.parametrize("part", [
    '<h2 id="related-work">Related work</h2>', '<h2 id="search-results">Search results</h2>', '<h2 id="comments">Comments</h2>',
    '<h3 id="menu">Menu</h3>', '<h2 id="login">Login</h2>', '<h2 id="search">Search</h2>', '<p class="notice-board">On the board</p>',
    '<p id="footer">Of footers</p>', '<section id="related-work"><h2>Related work</h2><p>Others did so before.</p></section>'])
def test_anchors_in_an_article_are_no_noise(part):
    page = f"<body><nav>Menu</nav><article><h1>Title</h1><p>{LONG}</p>{part}<p>{LONG}</p></article></body>"
    inner = [x for x in re.split("<[^>]*>", part) if x]
    assert main_text(page).split("\n") == ["Title", LONG, *inner, LONG]


@pytest.mark.parametrize("part", ['<div class="related-posts">More</div>', '<div id="comments"><p>So true!</p></div>',
                                  '<p class="notice">We use cookies</p>', '<section class="comments"><p>Me too</p></section>',
                                  '<section id="comments"><p>Me too</p></section>', '<div class="share-buttons">Share</div>'])
def test_noise_in_an_article_goes(part):
    page = f"<body><article><h1>Title</h1><p>{LONG}</p>{part}<p>{LONG}</p></article></body>"
    assert main_text(page).split("\n") == ["Title", LONG, LONG]


@pytest.mark.parametrize("script", ['<script src="a.js"/>var x=1;</script>', "<script src=/a/>var x=1;</script>",
                                    "<style media=all/>p { color: red }</style>"])
def test_scripts_are_never_self_closing(script):
    assert main_text(f"<article><p>{LONG}</p>{script}<p>End.</p></article>").split("\n") == [LONG, "End."]


def test_deep_nesting_is_linear():
    import time

    def seconds(depth):
        page = "<article>" + "".join(f'<div class="x{i}">Block {i} of the text.' for i in range(depth)) + "</div>" * depth + "</article>"
        start = time.perf_counter()
        assert main_text(page).count("\n") == depth - 1
        return time.perf_counter() - start

    seconds(500)
    assert seconds(16_000) < 16 * seconds(2_000) + 0.5
