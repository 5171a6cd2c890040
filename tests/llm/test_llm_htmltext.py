"""Main text of pages: whole tables by a plain reading of their layout, and small cases."""

import html as library
import re

import pytest

from tillcast.llm import htmltext


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>"


LONG = "A paragraph with quite some words in it that says something. " * 6
CASES = {
    "article": (page("<nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>One &amp; two &#233;"
                     f"<p>{LONG}</article><footer>&copy; me</footer>"), f"Title One & two é {LONG.strip()}"),
    "inline": (page(f"<article><p>a<b>b</b>c <i>d</i>\n\t e<br>f</p><p>{LONG}</p></article>"),
               f"abc d e f {LONG.strip()}"),
    "cut": (page("<header><h1>Site</h1></header><div class='cookie-notice'>We use cookies</div>"
                 f"<article><p>{LONG}</p><div class=\"ad banner\">Buy</div><form><label>Mail</label>"
                 f"</form><script>var a='<p>no</p>';</script><style>p{{}}</style><p>{LONG}</p>"
                 "<section id='comments'><p>Nice text, reader says.</p></section></article>"
                 "<aside>Other</aside>"), f"{LONG.strip()} {LONG.strip()}"),
    "no article": (page("<div id=sidebar><ul><li><a href=a>A</a><li><a href=b>B</a></ul></div>"
                        f"<div class=content><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><p>Short.</p></div>"
                        "<div class=footer>Imprint</div>"), f"Head {LONG.strip()} {LONG.strip()} Short."),
    "header in article": (page(f"<article><header><h1>Title</h1></header><p>{LONG}</p></article>"),
                          f"Title {LONG.strip()}"),
    "unclosed": (f"<body><article><ul><li>one<li>two</ul><p>{LONG}<table><tr><td>x<td>y</table>",
                 f"one two {LONG.strip()} x y"),
    "empty": ("", ""), "none": (None, ""), "no text": (page("<nav>Menu</nav>"), ""),
    "bare text": ("just &lt;text&gt;", "just <text>"), "comment": (page(f"<!-- no --><p>{LONG}"), LONG.strip()),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    html, expected = CASES[name]
    assert htmltext.main_text(html) == expected


def plain(html):
    """These pages have one article; its text is what stands between its tags."""
    inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", html, re.S)[1]
    inner = re.sub(r"</?(b|i|em|strong|a|span)\b[^>]*>", "", inner)
    return " ".join(library.unescape(re.sub(r"<[^>]+>", " ", inner)).split())


def test_whole_table(spark, small):
    pages = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    rows = htmltext.extract(pages).collect()
    assert len(rows) == len(html)
    for r in rows:
        assert r.text == plain(html[r.page_id]) and r.n_chars == len(r.text) > 0


def test_deep_and_long_pages():
    assert htmltext.main_text("<div>" * 20_000 + "deep") == "deep"
    assert len(htmltext.main_text(page(f"<article>{'<p>' + LONG}" * 3000 + "</article>"))) > 10 ** 6


def test_awkward_rows_and_columns(spark):
    rows = [(1, None, "x", 1), (1, None, "x", 1), (None, "<p>a", "x", 2)]
    frame = spark.createDataFrame(rows, "page_id long, html string, text string, N_CHARS int")
    got = htmltext.extract(frame)
    assert got.columns == ["page_id", "text", "N_CHARS", "text_", "n_chars_"]
    assert sorted(r.text_ for r in got.collect()) == ["", "", "a"]
    assert htmltext.extract(frame.limit(0)).count() == 0


TEXT = LONG.strip()
KEPT = {
    "slug ids": (page(f"<article><h2 id='how-to-search'>How</h2><p>{LONG}</p><section id='social-impact'>"
                      f"<h2 id=share-of-renewables>Share</h2><p class=login-flow>{LONG}</p></section>"
                      "</article>"), f"How {TEXT} Share {TEXT}"),
    "layout words": (page(f"<div class='content has-sidebar'><article><p>{LONG}</p></article></div>"), TEXT),
    "own name": (page(f"<div class='post-content no-sidebar'><p>{LONG}</p><p>{LONG}</p></div>"
                      "<div class='main-nav'>Menu</div>"), f"{TEXT} {TEXT}"),
    "form around": (page(f"<form id=aspnet><nav>Menu</nav><article><p>{LONG}</p></article></form>"), TEXT),
    "form without article": (page(f"<form><div><p>{LONG}</p><p>{LONG}</p></div></form>"), f"{TEXT} {TEXT}"),
    "unclosed ad": (page(f"<div class=ad>Buy<article><p>{LONG}</p></article>"), TEXT),
    "unclosed nav": (page(f"<nav><a href=x>Menu</a><article><p>{LONG}</p></article>"), TEXT),
    "comments as articles": (page(f"<article><p>{LONG}</p><section id=comments><article class=comment>"
                                  "<p>Nice.</p></article></section></article>"), TEXT),
    "numbered ad": (page(f"<article><p>{LONG}</p><div id=ad-2>Buy</div></article>"), TEXT),
}


@pytest.mark.parametrize("name", KEPT)
def test_names_and_wrappers(name):
    html, expected = KEPT[name]
    assert htmltext.main_text(html) == expected


SHORT = "<p>Short text.</p>"
FOREIGN = {
    "comments inside": (page(f"<article>{SHORT}<div class=comments><p>{LONG * 9}</p></div></article>"), "Short text."),
    "comments beside": (page(f"<article>{SHORT}</article><div class=comments><p>{LONG * 9}</p></div>"), "Short text."),
    "sidebar": (page(f"<div class=article-body><p>{LONG}</p></div><div class=sidebar>{f'<p>{LONG}</p>' * 5}</div>"), TEXT),
    "aside": (page(f"<div><p>{LONG}</p></div><aside>{f'<p>{LONG}</p>' * 5}</aside>"), TEXT),
    "paragraph of an ad": (page(f"<article><p>{LONG}</p><p class=ad>Buy this.</p><p class='ad-3'>And this.</p></article>"), TEXT),
    "articles in comments": (page(f"<article>{SHORT}</article><div id=comments><article><p>{LONG}</p></article></div>"),
                             "Short text."),
    "comment as article": (page(f"<article><p>{LONG}</p></article><article class=comment><p>{LONG}</p></article>"), TEXT),
    "parts": (page("<main>" + f"<article><h2>Part</h2><p>{LONG}</p></article>" * 3 + "</main>"),
              " ".join([f"Part {TEXT}"] * 3)),
    "posts": (page("<div>" + f"<article><p>{LONG}</p></article>" * 3 + "</div><nav><a href=x>Menu</a></nav>"),
              " ".join([TEXT] * 3)),
    "only article": (page(f"<div class=sidebar>Buy<article><p>{LONG}</p></article></div>"), TEXT),
    "open comment": (page(f"<article><p>{LONG}</p></article><!-- never closed <p>no</p>"), TEXT),
    "open tag": (f"<article><p>{LONG}</p></article><a href='x", TEXT),
    "stray signs": (f"<article><p>1 < 2 && 3 > 2 <3 </> </ p>{LONG}</p></article>", f"1 < 2 && 3 > 2 <3 {TEXT}"),
    "attributes": (f"<article data-a = 'x>y' b=\"<p>\" c=d/e checked><p>{LONG}</p></article>", TEXT),
    "raw": (f"<article><SCRIPT>if (a</b>) '</scriptx>'</SCRIPT ><p>{LONG}</p></article>", TEXT),
}


@pytest.mark.parametrize("name", FOREIGN)
def test_what_is_never_main_text(name):
    html, expected = FOREIGN[name]
    assert htmltext.main_text(html) == expected


HOSTILE = {
    "nested": "<div>" * 100_000 + "deep", "tags": "<a " * 350_000, "comments": "<!--" * 250_000,
    "inline": "<b>" * 200_000 + "x" + "</i>" * 100_000, "paragraphs": "<p><table><td>" + "<div>" * 100_000,
    "lists": "<ul><li>" * 60_000 + "<li>" * 60_000, "quotes": "<a b='" * 100_000 + '<a b="' * 100_000,
    "scripts": "<script>" * 100_000, "ends": "<div>" * 50_000 + "</p></span></td>" * 50_000,
    "signs": "<" * 1_000_000, "entities": "&amp" * 200_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_is_linear(name):
    import time
    start = time.perf_counter()
    htmltext.main_text(HOSTILE[name])
    assert time.perf_counter() - start < 8
