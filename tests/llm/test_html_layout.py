import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arcframe.llm import html_layout as h

CASES = {
    "implied ends and margins": ("<p>one<p>two<div>three<div>four</div></div>five <b>bold</b>  <i> it</i>x", "one\n\ntwo\n\nthree\nfour\nfive bold itx"),
    "nested lists": ("<ul><li>a<li>b<ol type=i start=3><li>x<p>y<li>z</ol></ul>after", "* a\n* b\n  iii. x\n\n       y\n  iv. z\n\nafter"),
    "ordered lists": ("<ol reversed><li>a<li value=7>b<li>c</ol><ol type=A><li>d</ol>", "3. a\n7. b\n6. c\n\nA. d"),
    "aligned cells": ("<table><caption>C</caption><tr><th>Name<th>Value<tr><td>alpha<td>1<tr><td>b<td>2000 <br>x</table>", "C\nName   Value\nalpha  1\nb      2000\n       x"),
    "spans": ("<table><tr><td rowspan=2>A<td>B<td>c<tr><td>C<td>d<tr><td colspan=2>wide cell here it is<td>z</table>tail", "A  B  c\n   C  d\nwide cell here it is  z\n\ntail"),
    "nested tables": ("<table><tr><td>x<td><table><tr><td>1<td>2<tr><td>3<td>4</table><tr><td>y<td>z</table>", "x  1  2\n   3  4\ny  z"),
    "style sheets": ("<style>.h{display:none} #q{visibility:hidden} p.z{display:none} @media print{p{display:none}}</style><p class='h a'>no<p>yes<p id=q>no <span style='visibility:visible'>seen</span><p class=z>no<div class=z>ok</div><div hidden>no</div>", "yes\n\nseen\n\nok"),
    "preformatted": ("<pre>\n a\n   b &lt;x&gt;</pre><textarea>\nt  t</textarea><script>if (a<b) '</p>'</script>c", " a\n   b <x>\n\nt  t\nc"),
    "quoted angle": ('<p title="a>b">x</p><p title=\'unclosed>rest', "x"),
    "signs": ("a < b && c > d <3 &amp; &copy; &nbsp;z <!-- c --> <!doctype x>e<![CDATA[x<y]]>", "a < b && c > d <3 & ©  z ex<y"),
    "hidden parts": ("<select><option>a<option>b</select><details><summary>S</summary>hid</details><details open><summary>S</summary>shown</details><template>t</template><input type=hidden value=v><input value=w>", "a\nb\nS\nS\nshown\nw"),
    "definitions and quotes": ("<dl><dt>t<dd>d1<dd>d2</dl><blockquote>q<p>r</blockquote>", "t\n  d1\n  d2\n\n  q\n\n  r"),
    "breaks": ("<p a=b=c>ok<br/>two</br>three<hr>four", "ok\ntwo\nthree\n\nfour"),
    "cells without a table": ("<td>loose</td><td>too", "loose too"),
    "head": ("<html><head><title>no</title><style>p{margin:0}</style><body><p>yes</body></html>", "yes"),
    "head without end": ("<head><title>no</title><p>yes", "yes"),
    "nothing": ("", ""),
    "broken off": ("a<p b='", "a"),
    "open comment": ("a<!-- b", "a"),
}


@pytest.mark.parametrize("case", CASES)
def test_layout(case):
    html, text = CASES[case]
    assert h.render(html)[0] == text


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td colspan=3>", "<td rowspan=2>", "</table>", "<b>", "</b>", "<div>", "</div>", "<pre>", "</pre>", "<br>", "<!--", "-->", "<script>", "</script>", "<a href='", "'>", "&amp;", "<", ">", "word", " ", "\n", "é", "<select><option>", "<caption>", "</td>", "<dl><dt>", "<dd>"]), max_size=40))
def test_any_markup_is_read(parts):
    text = h.render("".join(parts))[0]
    assert text == text.strip("\n") and not any(line.endswith(" ") for line in text.split("\n"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcé ", min_size=1, max_size=12).filter(str.strip), min_size=1, max_size=8), st.sampled_from(["p", "div", "li", "h2", "td", "span"]))
def test_every_word_is_kept_in_order(words, name):
    html = "".join(f"<{name}>{w}</{name}> " for w in words)
    assert h.render(html)[0].replace("* ", "").split() == " ".join(words).split()


@pytest.mark.parametrize("part", ["<a ", "<", "<p a='", "<b>", "<table><tr><td>", "<!--", "&", "<li>", "<a b=c ", "</x ", "<script>", '<p x="\n', "<div>", "<ul><li>", "<td rowspan=99 colspan=99>", "<tr><td rowspan=9999 colspan=1000>a", "<blockquote>a", "<style>@", "<style>.a{display:none}</style><p class=a>"])
def test_time_and_depth_are_bounded(part):
    began = time.time()
    h.render(part * 20_000)
    assert time.time() - began < 20


def test_query_rows(spark):
    pages = spark.createDataFrame([(1, "<p>x<li>y", "a"), (2, None, "b"), (None, "", "c"), (1, "<p>x<li>y", "d")], "page_id long, html string, text string")
    rows = sorted(map(tuple, h.extract_text(pages).collect()), key=str)
    assert rows == sorted([(1, "x\n\n* y", 3, 0, 1), (2, None, 0, 0, 0), (None, "", 0, 0, 0), (1, "x\n\n* y", 3, 0, 1)], key=str)
    assert h.extract_text(pages.where("false")).count() == 0


def test_wide_cells_are_aligned():
    long = "long cell " * 40
    text = h.render(f"<table><tr><td>{long}<td>x<tr><td>b<td>y</table>")[0].split("\n")
    assert text[0].index("x") == text[1].index("y") > 390


def test_a_table_of_very_wide_cells_stays_bounded():
    page = "<table><tr><td>" + "w" * 200_000 + "<td>x" + "<tr><td>b<td>y" * 20_000 + "</table>"
    text = h.render(page)[0]
    assert len(text) < 20 * len(page) and text.count("y") == 20_000


@pytest.mark.parametrize("sheet", ["a" * 400_000, "@" * 400_000, "{" * 400_000, "a{" * 200_000, "@media x{" * 50_000, "/*" * 200_000, "a{display:none" * 30_000, ".a,.b{x:y}" * 40_000])
def test_style_sheets_take_time_in_proportion(sheet):
    began = time.time()
    h.render(f"<style>{sheet}</style><p>x")
    assert time.time() - began < 3


def test_many_rules_and_elements():
    sheet = "".join(f".c{i}{{display:none}}" for i in range(20_000))
    began = time.time()
    text = h.render(f"<style>{sheet}</style>" + "".join(f"<p class='d c{i}'>no</p><p class=d{i}>y</p>" for i in range(20_000)))[0]
    assert text.split() == ["y"] * 20_000 and time.time() - began < 10


def test_rules():
    css = ".a{display:none} @import 'x'; @media print{.b{display:none}} .c{visibility:hidden; .d{display:none}} .e{display:none} p.f,#g{display:none}"
    assert [(s, h.declared(b)) for s, b in h.sheet_rules(css)][:2] == [(".a", {"display": "none"}), (".c", {"visibility": "hidden"})]
    page = "".join(f"<p class={c}>{c}</p>" for c in "abcdef") + "<div id=g>g</div><div class=f>h</div>"
    assert h.render(f"<style>{css}</style>{page}")[0].split() == ["b", "d", "h"]


@pytest.mark.parametrize("name", ["div", "blockquote", "ul><li", "table><tr><td", "b"])
def test_deep_nesting_keeps_every_word(name):
    html = "".join(f"<{name}>w{i} " for i in range(2000))
    assert [w for w in h.render(html)[0].split() if w != "*"] == [f"w{i}" for i in range(2000)]


def test_rows_that_cells_span():
    html = "<table><tr><td rowspan=0>a<td>b<td rowspan=2>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>"
    assert h.render(html)[0] == "a  b  c\n   d     e\n   f  g  h"
