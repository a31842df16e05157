"""Operator 13: main text of pages against the pages' own articles, crafted
pages and odd rows."""

import html
import re

import pytest

from roundlearn.llm import html_text, queries
from roundlearn.llm.common import read_table
from tests.llm.conftest import SF, SF_MID


def article(page):
    """The text between the article's tags, by pattern: right for the given tables, whose articles hold p, h1, b and br."""
    m = re.search(r"<article>(.*?)(</article>|<footer>)", page, re.S)
    s = re.sub(r"</?(p|h1|br)\b[^>]*>", " ", m[1])
    return " ".join(html.unescape(re.sub(r"<[^>]+>", "", s)).split())


@pytest.mark.parametrize("sf", [SF, SF_MID])
def test_pages_of_the_tables(spark, sf):
    want = {r.page_id: (r.url, article(r.html)) for r in read_table(spark, sf, "pages").collect()}
    got = queries.op13_html_text(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.url, r.text) == want[r.page_id] and r.n_chars == len(r.text)


@pytest.mark.parametrize("tag", ["div", "section", "td"])
def test_density_finds_the_article_without_its_element(spark, tag):
    for r in read_table(spark, SF_MID, "pages").collect():
        page = r.html.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag}>")
        assert html_text.main_text(page) == article(r.html)


P = "<p>" + "A sentence of the article that is long enough to count, with words. " * 4 + "</p>"
T = " ".join((re.sub("<.*?>", "", P)).split())
MENU = "<ul>" + '<li><a href="/x">Menu</a></li>' * 9 + "</ul>"


@pytest.mark.parametrize("page,want", [
    (f"<body><div id=menu>{MENU}</div><article><h1>Title</h1>{P}{P}</article><div class='comments'>{P}{P}{P}</div>",
     f"Title {T} {T}"),
    (f"<body><div>{MENU}</div><main><header><h1>T</h1></header><aside>{P}</aside>{P}<form>{P}</form></main><footer>{P}</footer>",
     f"T {T}"),
    (f"<body><div class='page with-sidebar'><div class=sidebar>{P}</div><article>{P}</article></div>", T),
    (f"<body><div class='cookie-notice'>{P}{P}{P}</div><div><h2>T</h2>{P}{P}</div>", f"T {T} {T}"),
    (f"<body><div>{MENU}</div><div><h2>T</h2>{P}{P}</div><div>{MENU}</div>", f"T {T} {T}"),
    (f"<body><article>{P}<article class=comment>{P}</article></article>", T),
    ("<p>a<b>b</b>c<br>d &amp;lt; &lt;e&gt; &#233;&eacute;&nbsp;f<script>var x='<p>';</script>g<!-- <p>no</p> -->h",
     "abc d &lt; <e> éé fgh"),
    ("plain text, 1 < 2 and <3", "plain text, 1 < 2 and <3"),
    ("<title>t</title><style>p{}</style>", ""), ("", ""), (None, ""), ("<p", ""), ("<!-- open", ""), ("a<b", "a"),
    ("<p>one<p>two<ul><li>x<li>y</ul>z", "one two x y z"),
    ("<script>if (a</b) '</p>'</script><p>ok</p>", "ok"),
    ("<b><p>x</b>y</p><div>z</span></div>", "xy z"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    ('<p title="a>b" class=\'c\'>t</p>', "t"),
])
def test_crafted_pages(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "x" + "</b>" * 50_000, "<b>" + "<div>" * 50_000 + "</b>" * 50_000, "<!--" * 300_000,
    "<a '" * 100_000, "<p>" * 50_000, "<table><tr><td>" * 20_000, "<script>" * 50_000, "<" * 200_000, "<a href=" * 100_000,
    "&" * 300_000, "<p>" + "word " * 300_000, "<li><a>" * 20_000, "</p>" * 100_000])
def test_long_and_nested_pages_end(page):
    html_text.main_text(page)


def test_odd_rows(spark):
    rows = [(1, "u", None, "x", 1), (1, None, "<p>a", None, 2), (1, None, "<p>a", None, 2), (None, "u", "", "y", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(str, html_text.extract(df).collect()))
    assert got == sorted(["Row(page_id=1, url='u', text='', n_chars=0)", "Row(page_id=None, url='u', text='', n_chars=0)"]
                         + ["Row(page_id=1, url=None, text='a', n_chars=1)"] * 2)
    assert html_text.extract(df.where("false")).count() == 0
