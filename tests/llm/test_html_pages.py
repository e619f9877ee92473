"""Pages that leave out tags or hold text in unusual places: what browsers show of them stays."""

import html.parser
import re
import time
from collections import Counter

import pytest

from strata.llm.html_layout import visible_text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<html><head><title>t</title><body><p>Hello", "Hello"),
        ("<html><head><title>t</title><p>Hello", "Hello"),
        ("<head><title>t</title> Hello <b>you</b>", "Hello you"),
        ("<head><noscript><link rel=x><body><p>Hello", "Hello"),
        ("<head><noscript><style>p{}</style><p>Hello", "Hello"),
        ("<head><noscript><img src=x>no</noscript><title>t</title><body>Hello", "Hello"),
        ("<head><template><p>no</template><meta charset=utf-8><style>p{}</style><script>1</script><h1>Hello", "Hello"),
        ("<head><title>t</title></head><body>Hello", "Hello"),
    ],
)
def test_head_without_end_tag(page, text):
    assert visible_text(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<table><tbody>Note<tr><td>1</table>", "Note\n1"),
        ("<table><form>Search<tr><td>1</form></table>z", "Search\n1\n\nz"),
        ("<table><tbody><form><p>In</p><tr><td>1<td>2</table>", "In\n\n1  2"),
        ("<table><form><td>1<td>2</table>", "1  2"),
        ("<table><tr><form><td>1<td>2</form></table>", "1  2"),
        ("<table><colgroup>Note<tr><td>1</table>", "Note\n1"),
        ("<table><tfoot hidden>Note<tr><td>no</tfoot><tr><td>1</table>", "Note\n1"),
    ],
)
def test_text_outside_of_rows(page, text):
    assert visible_text(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("a <svg><title>no</title><defs><text>no</text></defs><text>b</text><text>c<tspan>d</tspan></text></svg> e", "a b cd e"),
        ("<svg><title/><style/><path d='M0'/><text display='none'>no</text><text fill='none'>x</text></svg><p>y", "x\n\ny"),
        ("<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>no</annotation></semantics></math>.", "so x=1."),
        ("<filter>a</filter> <desc>b</desc>", "a b"),
    ],
)
def test_drawings_and_formulas(page, text):
    assert visible_text(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e</table>", "a  b  c\nd     e"),
        ("<table><tr><td rowspan=2 colspan=2>a<td>b<tr><td>c<tr><td>1<td>2<td>3</table>", "a     b\n      c\n1  2  3"),
        ("<table><thead><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d</table>", "a  b\nc  d"),
        ("<table><tr><td rowspan=2>a<td rowspan=2>b<tr></tr><tr><td>c</table>", "a  b\nc"),
        ("<table><tr><td rowspan=x>a<td rowspan=-1>b<tr><td>c</table>", "a  b\nc"),
    ],
)
def test_rowspan(page, text):
    assert visible_text(page) == text


def test_wide_tables_keep_their_text():
    n = 3000
    text = visible_text("<table>" + "".join(f"<tr><td rowspan=0>word{k}" for k in range(n)) + "</table>")
    assert text.split() == [f"word{k}" for k in range(n)] and len(text) < 100 * n


@pytest.mark.parametrize("page", ["<a " * 200_000, '<a "' * 200_000, "<" * 500_000, "<!-- " * 100_000, "<a '\"" * 100_000 + ">", "<a b='" * 170_000 + '">', "<a" * 400_000 + " '>", "<a " * 300_000 + "'>", "<a '" * 100_001 + '" >', "<div>" * 200_000, "<p><button>" + "<div>" * 150_000 + "</p>" * 50_000, "<svg>" * 150_000, "<li>" * 200_000])
def test_broken_pages_take_linear_time(page):
    began = time.time()
    visible_text(page)
    assert time.time() - began < 5


@pytest.mark.parametrize("page,text", [("<p>a<!-- b > c", "a"), ("a<!-- x", "a"), ("x <b>y</b> <!-- q <p>z", "x y"), ("a <b c", "a <b c"), ("<p>a<!-- b --> c", "a c")])
def test_ends_that_are_missing(page, text):
    assert visible_text(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<div>" * 600 + "<p hidden>secret<b>more</b></p>ok", "ok"),
        ("<div>" * 600 + "<div hidden>secret<div>more</div>still</div>ok" + "</div>" * 600 + "end", "ok\nend"),
        ("<span>" * 600 + "a<script>x</script><textarea>t</textarea>b", "atb"),
        ("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c<img alt=d></div>e", "b\ne"),
        ("<p style='background:url(display:none)'>a", "a"),
        ("<p style='display:block;DISPLAY : none'>a<p>b", "b"),
        ("<p style='display:none;display:block'>a", "a"),
        ("<ol><li>a<li value=9>b<li>c</ol>", "1. a\n9. b\n10. c"),
    ],
)
def test_what_hides_text(page, text):
    assert visible_text(page) == text


class _Words(html.parser.HTMLParser):
    """Words outside of elements that are never shown, by another parser; for pages without styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.off = Counter(), 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "template", "title", "noscript")

    def handle_endtag(self, tag):
        self.off = max(0, self.off - (tag in ("script", "style", "template", "title", "noscript")))

    def handle_data(self, data):
        if not self.off:
            self.words.update(re.findall(r"\w+", data))


def test_words_of_all_pages_by_another_parser(spark):
    rows = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if r.html]
    plain = [x for x in rows if not re.search(r"hidden|display|visib|<svg|<math|<select|<iframe|<object|<noscript|alt=|<video|<audio|<canvas|<textarea|<input|<template", x, re.I)]
    checked = 0
    for page in plain:
        other = _Words()
        other.feed(page)
        other.close()
        got = Counter(re.findall(r"\w+", visible_text(page)))
        got = Counter({w: n for w, n in got.items() if not w.isdigit()})
        want = Counter({w: n for w, n in other.words.items() if not w.isdigit()})
        assert "".join(sorted(got.elements())) == "".join(sorted(want.elements())) or got == want, page[:300]
        checked += 1
    assert checked >= 20
