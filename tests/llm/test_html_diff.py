"""HTML extraction: planted articles, differencing and hard markup."""

import random
import re
from html import unescape

import pytest

from tillbook.llm import html_diff as hd
from tillbook.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute_article(html):
    """The given pages hold one article of a heading and paragraphs."""
    body = re.search("<article>(.*?)</article>", html, re.S)[1]
    parts = [" ".join(unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?p>|</?h1>", body)]
    return "\n\n".join(p for p in parts if p)


def test_given_pages(spark):
    df = QUERIES["op4_html_extraction"](spark, SF)
    assert df.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r for r in df.collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        want = brute_article(p.html)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


@pytest.mark.parametrize("html, want", [
    ("", ""), ("plain &amp; text &lt;3", "plain & text <3"), ("<p>a<p>b <b>c</b>d<br>e", "a|b cd e"),
    ("<html><head><title>t</title><script>if (a<b) '</p>'</script></head><body class='has-sidebar'>x</body>", "x"),
    ("<nav>m<article>a</article>", "a"), ("<article>a<aside>s</aside>b<div class='comments'><div>c</div></div><p>d</article>z", "a|b|d"),
    ("<article><header><h1>h</h1></header><p class=notice>n<p>t</article>", "t"), ("<main><div id=cookie-consent>x</div>y</main>", "y"),
    ("<ul><li class=ad>one<li>two</ul><p>three", "two|three"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"), ("<div title='a>b'>c</div>", "c"),
    ("<article>a<!-- <p>no --> b<form><input><p>f</p></form></article>", "a b"), ("<p>&nbsp;x&#160;&#xe9;\n\ty</p>", "x é y"),
    ("<div class='advert'>a<div>b</div>c</div>d", "d"), ("<article>a</article><article>b</article>", "a|b"), ("<p>x<script>never closed", "x"),
    ("<article>x<span class='share'>s</span> y</article>", "x y"), ("<footer>f</footer>a<style>p{}</style>", "a"), ("<ARTICLE>Q</ARTICLE>", "Q"),
])
def test_markup(html, want):
    found = hd.blocks(html)
    inside = [t for t, x in found if x]
    assert "|".join(inside or [t for t, _ in found]) == want


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(400):
        a = [rng.randrange(5) for _ in range(rng.randrange(30))]
        b = [rng.randrange(5) for _ in range(rng.randrange(30))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = hd.shared_lines(a, b)
        rest = iter(b)
        assert len(got) == table[-1][-1] and got == sorted(set(got)) and all(any(a[i] == y for y in rest) for i in got)


def test_differencing(spark):
    def page(own, n):
        return f"<div>Site name</div><div>Menu x</div>{own}<div>Read more</div><div>{n}</div>"

    rows = [(1, "http://h.com/a/1", page("<p>story one</p>", 1)), (2, "http://h.com/a/2", page("<p>story two</p>", 2)),
            (2, "http://h.com/a/2", page("<p>story two</p>", 2)), (3, "http://h.com/b/9", page("<p>story nine</p>", 9)),
            (4, "http://other.com/a/1", page("<p>story one</p>", 1)), (5, "http://c.com/1", "<p>copy</p>"), (6, "http://c.com/1?x", "<p>copy</p>"),
            (7, None, "<p>no url</p>"), (8, "http://h.com/a/1x", None), (9, "http://h.com/e", ""), (None, "x", "<p>y</p>"),
            (10, "http://m.com/1", "<nav>n</nav><article>same<p>one</article>"), (11, "http://m.com/2", "<article>same<p>two</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS text", "'c' AS key", "'c' AS host", "'c' AS lines", "'c' AS rank")
    got = {r.page_id: r.text for r in hd.main_text(df).collect()}
    assert hd.main_text(df).count() == len(rows)
    assert got[1] == "story one\n\n1" and got[2] == "story two\n\n2" and got[3] == "story nine\n\n9"
    assert got[4] == "Site name\n\nMenu x\n\nstory one\n\nRead more\n\n1"  # alone on its host
    assert got[5] == got[6] == "copy" and got[7] == "no url" and got[8] == got[9] == "" and got[None] == "y"
    assert got[10] == "same\n\none" and got[11] == "same\n\ntwo"  # a marked article keeps shared lines
    assert hd.main_text(df.limit(0)).collect() == []


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in hd.main_text(df).collect()}


def test_every_page_is_differenced(spark):
    def page(n):
        return f"<div>Site name</div><div>Menu x</div><article>quoted<p>teaser {n}</article><div><p>main text {n}</div><div>Read more</div>"

    got = texts(spark, [(1, "http://t.com/a/1", page(1)), (2, "http://t.com/a/2", page(2)), (3, "http://t.com/a/3", page(3).replace("article>", "div>"))])
    assert got[1] == "quoted\n\nteaser 1\n\nmain text 1" and got[2] == "quoted\n\nteaser 2\n\nmain text 2"  # a teaser isn't the whole text
    assert got[3] == "teaser 3\n\nmain text 3"  # without a mark, shared lines go


def test_given_pages_are_aligned(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet").selectExpr("page_id", "url", "replace(html, '<body>', '<body><div>Planted site line</div>') AS html")
    hosts = {}
    for r in hd.main_text(df).collect():
        hosts.setdefault(re.sub("^[a-z]+://([^/?#]*).*", r"\1", r.url), []).append(r.text.startswith("Planted site line"))
    assert not any(any(kept) for kept in hosts.values() if len(kept) > 5)  # removed where a host has pages to compare


@pytest.mark.parametrize("html, want", [
    ("<article><h2 id='related-work'>a</h2><h2 id=social-impact>b</h2><section id='sharing-data'>c</section><p class='ad-hoc'>d<h3 id='notice-period'>e</h3></article>", "a|b|c|d|e"),
    ("<h2 id=comments>a</h2><p id=notice>b<p>c <span id=ad>d</span>", "a|b|c d"), ("<h2 id=header-files>a</h2><li class='menu-driven'>b", "a|b"),
    ("<article><div class='ad'>x<p>y</article><div>z</div>", "z"), ("<article>a<section class='related'>x<p>y</article>z", "a|z"),
    ("<div><div class=ad>x<span>y</div></div>z", "z"), ("<section>a<div class=ad>x<p>y</section>z", "a|z"), ("<p>a<span class=share>x<b>y</b></p>z", "a|z"),
    ("<article>a<div class=ad><article>x</article>y</div>b</article>c", "a|b|c"), ("<p>a<div class=ad>x</p>y</div>b", "a|b"),
    ("<ul><li>a<div class=ad>x</li><li>b</ul>c", "a|b|c"), ("<li class=ad><div>x</div>y<li>z", "z"), ("<ul><li class=ad>x</ul>a", "a"),
    ("<div class='sidebar-left'>x</div><div class='site-footer ad-300x250'>y</div><div id='cookie-consent'>z</div><div class='comments-area'>w</div>a", "a"),
])
def test_left_out_elements(html, want):
    assert "|".join(t for t, _ in hd.blocks(html)) == want


@pytest.mark.parametrize("name", ["post-comments", "reader-comments", "user-comments", "related-stories", "google-ad", "newsletter-signup", "primary-nav",
                                  "cookie-policy", "ad-leaderboard", "social-media-links", "userComments", "article__comments--open", "comment-form", "copyright-notice"])
def test_boxes_by_their_head_word(name):
    assert "|".join(t for t, _ in hd.blocks(f"<article><h1>a</h1><p>b</p><div class='{name}'><p>x</p>y</div><p>c</article>")) == "a|b|c"
    for text in ("h2", "p"):  # never a heading or a paragraph
        assert "|".join(t for t, _ in hd.blocks(f"<article><{text} class='{name}'>a</{text}><p>b</article>")) == "a|b"


@pytest.mark.parametrize("name", ["has-sidebar", "post-header", "share-price", "social-impact", "content-with-sidebar", "ad-hoc-query", "notice-period", "sharing-data", "hero-banner"])
def test_boxes_that_only_mention_a_word_stay(name):
    assert "|".join(t for t, _ in hd.blocks(f"<article>a<div class='{name}'><h1>b</h1>c</div>d</article>")) == "a|b|c|d"


def test_a_box_around_the_whole_page():
    assert hd.blocks("<div class='content-sidebar-wrap'>x<main><h1>a</h1><p>b</main></div>") == [("a", True), ("b", True)]


def test_lines_of_boxes_are_aligned_too(spark):
    def page(n):
        return (f"<head><title>t</title></head><nav><a>home</a><p>today {n}</p></nav><div>Site line</div><article><h1>Weekly</h1><p>own {n}</p>"
                f"<div class='share-price'>Buy now</div></article><footer>Imprint</footer>")

    rows = [(i, f"http://h.com/a/{i}", page(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in hd.extract(df).collect()}
    for i, r in got.items():
        assert r.text == f"Weekly\n\nown {i}"  # the article's own shared heading stays, the shared line of a doubtful box goes
        assert r.n_shared == 4 and r.n_boxed == 1  # home, Site line, Buy now, Imprint; then the menu's own line


def test_given_pages_lose_shared_lines(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = hd.extract(pages).collect()
    assert sum(r.n_shared for r in rows) > 0  # on the unchanged tables
    lines = {p.page_id: hd.page_blocks(p.html) for p in pages.collect()}
    for r in rows:
        found = lines[r.page_id]
        assert r.n_shared + r.n_boxed == sum(x.boxed for x in found) and len([x for x in r.text.split("\n\n") if x]) == sum(not x.boxed for x in found)


def test_slices_of_long_pages(spark, monkeypatch):
    rows = [(i, f"http://h.com/{i}", f"<p>own {i} " + "long " * (20_000 if i % 3 else 2) + "</p><p>same</p>") for i in range(40)]
    monkeypatch.setattr(hd, "SLICE_BYTES", 150_000)
    got = texts(spark, rows)
    assert len(got) == 40 and all(got[i].startswith(f"own {i} long") and not got[i].endswith("same") for i in range(40))


def test_copies_stand_for_each_other(spark):
    def page(own):
        return f"<div>Site name</div><div>Menu x</div><p>{own}</p><div>Read more</div>"

    rows = [(i, f"http://h.com/a/1{end}", page("story one")) for i, end in enumerate(["", "?print=1", "?s=2", "/copy", "0?s=2"])]
    rows += [(10, "http://h.com/a/0", page("story nought")), (11, "http://h.com/b", page("story two")), (12, "http://only.com/1", page("x")), (13, "http://only.com/2", page("x"))]
    rows += [(14, "http://h.com/a/1?m", page("story one").replace("div>", "article>", 2))]  # a copy by its lines, with a mark
    got = texts(spark, rows)
    assert {got[i] for i in range(5)} == {"story one"} and got[10] == "story nought" and got[11] == "story two"
    assert got[12] == got[13] == "Site name\n\nMenu x\n\nx\n\nRead more"  # copies alone on their host
    assert got[14] == "Site name\n\nstory one"
