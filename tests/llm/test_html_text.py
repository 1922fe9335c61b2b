"""Main text of pages: against a plain reading of the given pages, boilerplate inside the article, and linear time."""

import html
import re
import time

import pytest

from tidelake.llm import html_text, queries

DIR = "/root/testdata/sf0.01"
PARAGRAPH = "A paragraph, with commas, that is long enough, to count as text of the page. " * 4


def plain(page):
    """The given pages hold one article without boilerplate inside: its blocks by splitting at block tags."""
    article = re.search(r"<article>(.*?)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h1|h2|h3|ul|ol|li|div|blockquote|pre|table|tr|td|th)(?:\s[^>]*)?>", article[1] if article else "")
    texts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<(?:br|hr|img|wbr)\b[^>]*>", " ", x)))).strip() for x in parts)
    return "\n".join(x for x in texts if x)


def test_given_pages_equal_a_plain_reading(spark):
    want = {r["page_id"]: plain(r["html"]) for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    got = queries.op1_html_text(spark, DIR).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


BOILERPLATE = [
    '<div class="sidebar-left"><p>Side text, of this.</p></div>',
    '<div class="comment-body">I, too, think so.</div>',
    '<section class="entry-comments"><p>Reader says</p></section>',
    '<div id="cookie-notice"><p>We use cookies</p></div>',
    "<h3>Related</h3><ul><li><a href=/a>Other page</a></li><li><a href=/b>Another</a></li></ul>",
    "<h2>Comments (2)</h2><ol><li><p>First!</p></li></ol>",
    "<h2>2 Kommentare</h2><ol><li><p>Erster!</p></li></ol>",
    "<article><p>A reader, with an answer.</p></article>",
]
OWN = [
    ('<section class="market-share"><p>Shares rose.</p></section>', ["Shares rose."]),
    ("<h2>Sources</h2><ul><li><a href=/1>First source</a></li></ul>", ["Sources", "First source"]),
    ("<h2>Related</h2><p>Work by others, told in full.</p>", ["Related", "Work by others, told in full."]),
    (f'<div class="text with-sidebar"><p>{PARAGRAPH * 9}</p></div>', [(PARAGRAPH * 9).strip()]),
]


@pytest.mark.parametrize("part, blocks", [*((x, []) for x in BOILERPLATE), *OWN])
def test_parts_inside_the_article(part, blocks):
    outers = ["article"] if "<article>" in part else ["article", "main"]
    for outer in outers:
        page = f"<body><{outer}><p>{PARAGRAPH}</p>{part}<p>{PARAGRAPH}</p></{outer}></body>"
        assert html_text.main_text(page).split("\n") == [PARAGRAPH.strip(), *blocks, PARAGRAPH.strip()]


def test_a_teaser_beside_the_article_goes():
    page = f"<body><article><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></article><article><h2>Teaser</h2><p>Short, teaser.</p></article></body>"
    assert "Teaser" not in html_text.main_text(page)


@pytest.mark.parametrize(
    "page",
    [
        lambda n: "<div>" * n + "<body>" * n,
        lambda n: "<b>" * n + "<div></div>" * n,
        lambda n: "<li><ul>" + "<div>" * n + "<li></li>" * n,
        lambda n: "<table>" + "<td>" * n + "<div>" * n + "<td>" * n,
        lambda n: "<article>" * n + "x",
        lambda n: "<article>" + "<h2>Related</h2><ul><li><a>x</a></ul>" * n,
    ],
)
def test_time_grows_with_the_page(page):
    def took(n):
        text = page(n)
        began = time.perf_counter()
        html_text.main_text(text)
        return time.perf_counter() - began

    took(100)
    assert took(20_000) < 40 * max(took(2_000), 0.01)
