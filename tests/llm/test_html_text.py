"""Rendering rules on small pages, and all visible words of the given pages by another parser."""

import re
from html.parser import HTMLParser

import pytest

from tablewarden.llm.html_text import page_texts, rendered
from tablewarden.llm.queries import op4_html_text

from .hard import empty_frame, hard_frame

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<div>a</div><div>b</div>", "a\nb"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("x<b>y</b> <i>z</i>&nbsp;&amp;&lt;&#233;", "xy z\xa0&<é"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
        ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
        ("<table><tr><th>Name<th>n<tr><td>long name<td>1<tr><td colspan=2>over both</table>", "Name       n\nlong name  1\nover both"),
        ("<table><tr><td>日本<td>x<tr><td>abcde<td>y</table>", "日本   x\nabcde  y"),
        ("<pre> a\n   b</pre>c", " a\n   b\n\nc"),
        ("<head><title>t</title><style>p{}</style></head><script>if(a<b)'</p>'</script>seen<!-- not -->", "seen"),
        ("<p hidden>no<p style='display : none'>no<p aria-hidden=true>no<p>yes", "yes"),
        ("<noscript>no</noscript><template>no</template><img alt=pic>", "pic"),
        ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
        ("a</div></p></table>b", "a\n\nb"),
        ("<a title='x>y'>z", "z"),
        # Any depth: hidden text stays hidden, and nothing behind it does.
        ("<div>" * 120 + "<div hidden>secret</div>shown", "shown"),
        ("<div>" * 98 + "<div style='display:none'><p>a<div>b</div>c</div>shown", "shown"),
        ("<b>" * 50_000 + "<i hidden>no</i>" + "yes", "yes"),
        # Visibility is inherited and can be given back.
        ("<div style='visibility:hidden'>no<p style='visibility: visible'>yes</p>no</div>", "yes"),
        ("<ul style='visibility:hidden'><li>no<li style='visibility:visible'>yes</ul>", "- yes"),
        ("<ol><li>a<li style='visibility:hidden'>no<li>c</ol>", "1. a\n3. c"),
        ("<pre>a\n<b style='visibility:hidden'>no</b>\nc</pre>", "a\n\nc"),
        ("<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>yes</table>", "  yes"),
        # Cells over several rows and columns.
        ("<table><tr><td rowspan=2>Name<td>a<td>b<tr><td>c<td>d</table>", "Name  a  b\n      c  d"),
        ("<table><tr><td>x<td rowspan=0>y<tr><td>long<tr><td>z<td>w</table>", "x     y\nlong\nz        w"),
        ("<table><tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d</table>", "a  b\nc  d"),
        ("<table><tr><td colspan=1000>wide<td>e<tr><td>a<td>b</table>", "wide  e\na  b"),
        ("<table><tr><td colspan=2>longer than both<td>c<tr><td>a<td>b<td>d</table>", "longer than both  c\na  b  d"),
        # Quotes that are never closed.
        ("<a title='x>y</a> z", "y z"),
        ("<p class=it's>one<p title=\"two>three", "one\n\nthree"),
        ("<a don't>z</a>", "z"),
    ],
)
def test_rules(markup, text):
    assert rendered(markup) == text


@pytest.mark.parametrize("markup", [
    "<ul><li>x" * 20_000, "<blockquote>q" * 20_000, "<table><tr><td>a<td>b" * 5_000, "<p><table>" + "<div>" * 30_000 + "<li><span>y" * 5_000,
    "<table>" + "<tr><td rowspan=9>r<td>s" * 3_000 + "</table>", "<table><tr><td>" + "w" * 300_000 + "<td>x" + "<tr><td>a<td>b" * 5_000,
])
def test_large_layouts_stay_small_and_whole(markup):
    text = rendered(markup)
    assert len(text) < 60 * len(markup) + 1000
    for letter in "xqabyrsw":
        given = len(re.findall(f"(?<=>){letter}+(?=<|$)", markup))
        assert len(re.findall(f"(?<![a-z]){letter}+(?![a-z])", text)) == given


@pytest.mark.parametrize("markup", ["<", "<a", "</", "<!--", "a<b c", "<p a='", "<script>x", "&#xFFFFFFF;", "<ul>" * 3000 + "x", "<table><tr><td>" * 800 + "y", "<b>" * 5000 + "z" + "</b>" * 5000])
def test_broken_and_deep_markup_never_fails(markup):
    assert isinstance(rendered(markup), str)


class Visible(HTMLParser):
    def __init__(self):
        super().__init__()
        self.hidden, self.parts = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("head", "script", "style", "title"):
            self.hidden.append(tag)
        else:
            self.parts.append(" " if tag not in ("b", "a", "i", "span") else "")

    def handle_endtag(self, tag):
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()
        elif tag not in ("b", "a", "i", "span"):
            self.parts.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def test_given_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = op4_html_text(spark, SMALL).collect()
    assert len(rows) == len(pages)
    for row in rows:
        parser = Visible()
        parser.feed(pages[row["page_id"]])
        parser.close()
        own = row["text"].split()
        assert [w for w in own if w != "-"] == "".join(parser.parts).split()
        assert row["n_lines"] == len(row["text"].split("\n"))


def test_nulls_and_clashes(spark):
    df = spark.createDataFrame([(1, "<p>a", "old"), (1, "<p>a", "old"), (None, None, None)], "page_id bigint, html string, text string")
    assert sorted(((r["page_id"], r["text"]) for r in page_texts(df).collect()), key=repr) == [(1, "a"), (1, "a"), (None, "")]
    assert page_texts(df.limit(0)).count() == 0


def test_hard_empty_and_clashing_rows(spark):
    df = hard_frame(spark, extra=True).withColumnRenamed("text", "html")
    rows = page_texts(df).collect()
    assert len(rows) == df.count() and {r["key"] for r in rows} == {"clash"}
    want = sorted((r["doc_id"] or -1, rendered(r["html"])) for r in df.collect())
    assert sorted((r["doc_id"] or -1, r["text"]) for r in rows) == want
    assert page_texts(empty_frame(spark), markup="text").count() == 0
