"""Rendering of pages, tables against a plain grid."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duewatch.llm.html_text import extracted, render

CASES = [
    ("<p>a<p>b <b>c</b>\n d<br>e", "a\n\nb c d\ne"),
    ("<ul><li>a<li>b<ol><li>x<li>y</ol><li>c</ul>after", "- a\n- b\n  1. x\n  2. y\n- c\n\nafter"),
    ("<ol start=5 reversed><li>a<li>b<li value=9>c</ol>", "5. a\n4. b\n9. c"),
    (
        "<table><tr><th>Name<th>N<tr><td>alpha<td>1<tr><td rowspan=2>r<td>10<tr><td>2</table>",
        "Name   N\nalpha  1\nr      10\n       2",
    ),
    ("<table><tbody><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>", "wide  z\na  b  c"),
    ("<table><caption>cap</caption><td>a<td>b</table>t", "cap\na  b\n\nt"),
    ("<table><tr><td>a<table><tr><td>in<td>n2</table><td>b</table>", "a in n2  b"),
    ("<div>a<span style='Display : none'>no</span> b</div><div hidden>x</div>c<script>var t='</p>';</script>d", "a b\ncd"),
    ("<head><title>t</title><style>p{}</style></head><body>x<template>y</template><!-- z --><noscript>n</noscript>", "x"),
    ("x &amp; y &lt;z&gt; <pre> a\n  b</pre>t", "x & y <z>\n\n a\n  b\n\nt"),
    ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n  d1\n  d2"),
    ("<p>1</div></p>2", "1\n\n2"),
    ("a<hr>b", "a\n---\nb"),
    ("< 3 <a href='x>y'>l</a> <b", "< 3 l"),
    ("<input type=submit value=Go><input type=hidden value=no><select><option>one<option>two</select>", "Go\none\ntwo"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("one<br><br>two", "one\n\ntwo"),
    ("<blockquote>q</blockquote>r", "  q\n\nr"),
    ("<table>Hello<tr><td>x</table>", "Hello\n\nx"),
    ("a<table><tr><div>Hello</div></tr></table>b", "a\nHello\n\nb"),
    ("<table><form><p>Hello</p><tr><td>x<td>y</form><tr>there<td>z</table>", "Hello\n\nthere\n\nx  y\nz"),
    ("<table><tr><td>a</td>b<td>c</tr>d</table>e", "bd\n\na  c\n\ne"),
    ("<table><tr><td>o<table>in<tr><td>x</table><td>p</table>", "oin x  p"),
    ("<table><tr><div>one<td>x<td>y</table>", "one\n\nx  y"),
    ("<table><table><tr><td>x</table>", "x"),
    ("<table><colgroup><col>Hello<tr><td>x</table>", "Hello\n\nx"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_cases(html, text):
    assert render(html) == text


def test_deep_and_long():
    assert render("<div>" * 30_000 + "deep") == "deep"
    assert render("<ul><li>" * 300 + "x").strip("- ") == "x"
    assert len(render("<p>word " * 50_000)) > 250_000


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([
    "<table>", "</table>", "<tr>", "<td>", "</td>", "<th colspan=3>", "<td rowspan='2'>", "<ul>", "</ul>", "<li>", "<ol>", "<p>", "</p>",
    "<pre>", "</pre>", "<div hidden>", "</div>", "<br>", "<textarea>", "</textarea>", "<caption>", "<dd>", "<blockquote>", "</blockquote>",
    "word", " ", "\n", "&nbsp;", "&#x;", "<", "<!--", "-->", "<script>", "</script>", "<select>", "<option>", "</li>", "</tr>",
]), st.text(max_size=4)), max_size=30))
def test_any_markup_is_rendered(parts):
    assert isinstance(render("".join(parts)), str)


def test_rows(spark):
    rows = [(1, None, "u"), (None, "<p>x", "u"), (2, "<p>y", "u"), (2, "<p>y", "u")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    assert sorted(map(repr, extracted(df).collect())) == sorted(
        ["Row(page_id=1, text='')", "Row(page_id=None, text='x')", "Row(page_id=2, text='y')", "Row(page_id=2, text='y')"]
    )
    assert extracted(df.limit(0)).collect() == []


def plain_table(rows):
    """Every slot of the grid marked one by one; columns padded to their widest cell."""
    slots, placed = set(), []
    for y, row in enumerate(rows):
        x = 0
        for text, across, down in row:
            while any((y, x + k) in slots for k in range(across)):
                x += 1
            for k in range(across):
                slots.update((y + d, x + k) for d in range(down))
            placed.append((y, x, across, text))
            x += across
    widths = [max([len(t) for _, x, n, t in placed if (x, n) == (k, 1)], default=0) for k in range(200)]
    lines = []
    for y in range(len(rows)):
        line, column = "", 0
        for _, x, across, text in sorted(c for c in placed if c[0] == y and c[3]):
            line += " " * sum(w + 2 for w in widths[column:x])
            line += text.ljust(sum(w + 2 for w in widths[x : x + across]) - 2) + "  "
            column = x + across
        lines.append(line.rstrip())
    return "\n".join(line for line in lines if line)


CELL = st.tuples(st.sampled_from(["", "a", "bb", "three", "cc dd"]), st.integers(1, 4), st.integers(1, 4))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(CELL, max_size=6), min_size=1, max_size=6))
def test_random_tables(rows):
    html = "".join(
        "<tr>" + "".join(f"<td colspan={across} rowspan={down}>{text}" for text, across, down in row) for row in rows
    )
    assert render(f"<table>{html}</table>") == plain_table(rows)


def test_wide_rows_take_time_by_their_cells():
    begin = time.process_time()
    text = render("<table><tr>" + "<td>x" * 5000 + "</table>")
    assert text.split() == ["x"] * 5000 and time.process_time() - begin < 1
    begin = time.process_time()
    spans = render("<table><tr>" + "<td rowspan=1000>x" * 2500 + "<tr><td>y" * 999 + "</table>")
    assert spans.split().count("y") == 999 and time.process_time() - begin < 5


@pytest.mark.parametrize("html", [
    "<table><tr><td>" + "long " * 5000 + "<td>e" + "<tr><td>a<td>b" * 1000 + "</table>",
    "<table><tr>" + "<td rowspan=1000>x" * 2500 + "<tr><td>y" * 999 + "</table>",
    "<table><tr><td colspan=1000>a<td colspan=1000>b<td>c</table>" * 1000,
])
def test_padding_does_not_outgrow_the_page(html):
    text = render(html)
    assert len(text) < 20 * len(html)
    assert sorted("".join(text.split())) == sorted("".join(render(html.replace("<td", " <p")).split()))


def test_a_table_too_sparse_to_align():
    assert render("<table><tr><td>" + "w" * 2000 + "<td>e<tr><td>a<td>b" + "<tr><td>c<td>d" * 9 + "</table>").endswith("c  d")


def test_alignment_does_not_depend_on_the_size_of_a_table():
    """More rows of the same kind leave the first ones as they are, however sparse the table is."""
    wide, sparse = "<tr><td>" + "w" * 150 + "<td>e", "<tr><td>a<td>b"
    few = render(f"<table>{wide}{sparse}</table>").split("\n")
    many = render(f"<table>{wide}{sparse * 500}</table>").split("\n")
    assert few == many[:2] and set(many[1:]) == {"a" + " " * 151 + "b"}
    assert render(f"<table>{wide.replace('w', 'ww')}{sparse}</table>").split("\n")[1] == "a  b"
