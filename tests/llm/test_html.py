import html as entities
import re

import pytest

from ratelab.llm import html, queries

LONG = "The end of the road is where all of us will be with the others and that is what it was for in the first place."


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   <p> </p>", ""), ("plain text &amp; more", "plain text & more"), ("<p>hi", "hi"),
    (f"<title>x</title><nav><a href=/>Home</a></nav><p>{LONG}</p><footer>&copy; me</footer>", LONG),
    (f"<div class='site-menu'>{LONG}</div><p>{LONG}</p><div id=cookieNotice>{LONG}</div>", LONG),
    (f"<article><h1>Title</h1><p>{LONG}</p><aside>{LONG}</aside><p>Short.</p></article><section class='comments'><p>{LONG}</p></section>", f"Title {LONG} Short."),
    ("<article><p>Sthe.</p></article><footer>x y</footer>", "Sthe."),
    (f"<header><h1>Site</h1></header><main><header><h1>T</h1></header><p>{LONG}</p></main>", f"T {LONG}"),
    (f"<p>{LONG}</p><form><p>{LONG}</p><input value='>'><button>Go</button></form>", LONG),
    (f"<script>var t='</p>';</script><style>p{{}}</style><p>{LONG}<!-- no > --></p><noscript>off</noscript>", LONG),
    ("<p>a&nbsp;&#233;&eacute;<br>b \n\t c</p>", "a éé b c"), ("<p>1 < 2 & 3</p>", "1 < 2 & 3"), ("<p><![CDATA[a & b]]></p>", "a & b"),
    (f"<p>{LONG}</p><p><a href=x>one</a> <a href=y>two</a></p>", LONG), (f"<p hidden>{LONG}</p><p style='display: none'>{LONG}</p><p>{LONG}</p>", LONG),
    (f"<div class=ad>{LONG}</div><p>Open short block</p><p>{LONG}</p>", f"Open short block {LONG}"),
    (f"<nav>{LONG}</nav><p>Alone</p><div>x</div><div>y</div><div>z</div><p>{LONG}</p>", f"y z {LONG}"),
    ("<p>" + "word and the " * 100_000 + "</p>", ("word and the " * 100_000).strip()), ("<a href=\"x>y", ""), ("<p>a</div></p>b", "a b"),
])
def test_pages(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("page", [
    "<div class='content has-sidebar'><p>{}</p></div>", "<div class='page no-header'><p>{}</p></div>", "<div class='elementor-widget text'>{}</div>",
    "<article class='post tag-social'><p>{}</p></article>", "<a name=top><p>{}</p>", "<a name='x'>{}</a>", "<p title=it's>{}</p><p class=b>that's</p>".replace("<p class=b>that's</p>", ""),
    "<div class='page no-header'><div class='sidebar'><p>Of the menu and the rest of it</p></div><p>{}</p></div>",
    "<div id=wrapper-widget><nav><a href=/>Home</a></nav><div class=share>and so on</div><p>{}</p><footer>f</footer></div>", "<p><a href=x>Home</p><p>{}</p>",
])
def test_names_and_anchors_do_not_lose_the_page(page):
    assert html.main_text(page.format(LONG)) == LONG


def test_comments_stay_out_however_long():
    comments = f"<div class=comments><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>"
    assert html.main_text(f"<article><p>{LONG}</p></article>{comments}") == LONG
    assert html.main_text(f"<article><p>{LONG}</p>{comments}</article>") == LONG


def test_depth_costs_no_more_than_length():
    page = "<div>" * 20_000 + f"<p>{LONG}</p>" + "</div>" * 20_000 + "</span>" * 20_000
    assert html.main_text(page) == LONG


def test_blocks_know_links_and_furniture():
    found = html.blocks("<ul><li><a href=x>Home page</a></li></ul><p>Text <a>in</a></p><footer>f</footer>")
    assert [(b.text, b.linked, b.furniture) for b in found] == [("Home page", 8, False), ("Text in", 2, False), ("f", 0, True)]


def test_extract_odd_rows(spark):
    rows = [(1, "u", "<p>a</p>", "t"), (1, "u", "<p>a</p>", "t"), (None, None, None, "t"), (2, "v", "", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in html.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", "a"), (1, "u", "a"), (None, None, ""), (2, "v", "")], key=str)
    assert html.extract(df.limit(0)).count() == 0


def test_query_returns_whole_articles(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in queries.QUERIES["op10_html_extraction"](spark, folder).collect()}
    for p in spark.read.parquet(f"{folder}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        want = " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url
