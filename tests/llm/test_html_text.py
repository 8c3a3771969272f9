from html import escape
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shipcause.llm.html_text import extract_pages, page_text

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("a  b\n c", "a b c"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<div>one<div>two</div>three</div>", "one\ntwo\nthree"),
        ("one<br>two<br><br>three", "one\ntwo\n\nthree"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "  - a\n  - b\n      - c"),
        ("<ol start=9><li>a<li>b</ol>", " 9. a\n10. b".replace(" 9", " 9")),
        ("<table><tr><th>H<th>Long<tr><td>wide cell<td>x</table>", "H          Long\nwide cell  x"),
        ("<table><td>a<br>b<td>c</table>", "a  c\nb"),
        ("a<table><td>x<table><td>in</table></table>b", "a\n\nx\n\nin\n\nb"),
        ("<pre> a\n   b </pre>", " a\n   b"),
        ("x<script>var a = '<p>no</p>'</script><style>p{}</style><!-- no -->y", "xy"),
        ("<p hidden>no<p style='display : none'>no<p style='visibility:hidden'>no<p>yes", "yes"),
        ("<title>no</title><body>a &amp; b &lt;&copy;&am", "a & b <©&am"),
        ("<b>bold</b> and<i> it</i>", "bold and it"),
        ("<p><b>x<br><p>y", "x\n\ny"),
        ("1 < 2 <3", "1 < 2 <3"),
        ("<dl><dt>t<dd>d</dl>", "t\n    d"),
        ("<img alt='a picture'><input type=submit value=Go>", "a pictureGo"),
        ("</p>x</div></table>y", "xy"),
    ],
)
def test_layout(html, text):
    assert page_text(html).strip("\n").splitlines() == text.splitlines() or page_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<div style='backface-visibility:hidden; -webkit-backface-visibility: hidden'>card</div>", "card"),
        ("<p style='--display:none'>a<p style='background:url(x;display:none)'>b<p style='/* display:none */'>c", "a\n\nb\n\nc"),
        ("<p style='display:none; display:block'>a<p style='display:none !important; display:block'>no", "a"),
        ("<p style='color:red;DISPLAY : None'>no<p style='content-visibility:hidden'>no<p>a", "a"),
        ("<div style='visibility:hidden'>no<p>no<b style='visibility:visible'>yes</b></div>", "yes"),
        ("<ul style='visibility:hidden'><li>no<li style='visibility:visible'>a</ul>", "  - a"),
        ("<table><tr style='visibility:collapse'><td style='visibility:visible'>no<tr><td>a</table>", "a"),
        ("a<!-->b", "ab"),
        ("a<!--->b<!-- no -->c", "abc"),
        ("Note: <textarea>\none &amp;\n  two</textarea> end", "Note: one &\n  two end"),
        ("Pick <select><option>a<option selected>b<optgroup label=More><option>c</select> now", "Pick\na\nb\nMore\nc\nnow"),
        ("so <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math> holds", "so x=1 2 holds"),
        ("<math><semantics><mi>x</mi><annotation>no</annotation></semantics></math>", "x"),
        ("<svg><title/><defs/><desc>no</desc>no<g><text>one <tspan>two</tspan></text><text><![CDATA[a<b]]></text></g></svg>", "one two\na<b"),
        ("<svg><text visibility=hidden>no</text><text display=none>no</text><foreignObject><p>yes</p></foreignObject></svg>", "yes"),
        ("<svg><title>no<path></svg>after<svg><g><p>out", "after\n\nout"),
    ],
)
def test_what_browsers_show(html, text):
    assert page_text(html) == text


def test_depth_and_length_do_not_matter():
    assert page_text("<div>" * 20_000 + "x") == "x"
    assert page_text("<p>x" * 20_000).count("x") == 20_000
    assert page_text("<" * 50_000) == "<" * 50_000
    assert page_text("<div><p>" * 20_000) == ""


def test_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    odd = spark.createDataFrame([(None, "u", "<p>x"), (1, None, None), (1, None, None)], "page_id long, url string, html string")
    rows = extract_pages(pages.unionByName(odd).withColumn("text", F.lit("old"))).collect()
    assert len(rows) == pages.count() + 3
    for r, html in zip(rows, [r.html for r in pages.collect()], strict=False):
        assert r.text == page_text(html) and "track(" not in r.text and "©" in r.text
    assert extract_pages(odd.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<ol start=--5><li>a</ol>", "1. a"),
        ("<ol start=²><li>a</ol>", "1. a"),
        (f"<ol start={'9' * 5000}><li>a</ol>", "1. a"),
        ("<ol start=' +7x'><li>a</ol>", "7. a"),
        ("<ol start=-3><li>a<li>b</ol>", "-3. a\n-2. b"),
        ("<table><tr><td colspan=²>a<td>b</table>", "a  b"),
        ("<table><tr><td colspan=-1 rowspan=x>a<td>b</table>", "a  b"),
        ("<p title=it's>hello</p><p>you're</p>", "hello\n\nyou're"),
        ("<div class=\"a\"\">hello</div><p title=\"x\">bye</p>", "hello\n\nbye"),
        ("<p title = 'a > b' lang=\"x\">one</p>", "one"),
        ("<p title=\"never closed>one</p><p>two</p>", "one\n\ntwo"),
        ("<table><tr><td rowspan=2>A<td>b1<tr><td>b2</table>", "A  b1\n   b2"),
        ("<table><tr><td>x<td rowspan=0>long<td>1<tr><td>y<td>2<tr><td>z<td>3</table>", "x  long  1\ny        2\nz        3"),
        ("<table><tr><td rowspan=2 colspan=2>A<td>b<tr><td>c<tr><td>d<td>e<td>f</table>", "A     b\n      c\nd  e  f"),
        ("<table><tr><td rowspan=99999999>a<td>b</table>after", "a  b\n\nafter"),
    ],
)
def test_odd_tags_numbers_and_spans(html, text):
    def tidy(t):
        return [line.strip() for line in t.strip().splitlines() if line.strip()]

    assert tidy(page_text(html)) == tidy(text)


def test_columns_below_a_span():
    lines = page_text("<table><tr><td rowspan=2>A<td>b1<tr><td>b2</table>").strip("\n").split("\n")
    assert lines == ["A  b1", "   b2"]


def test_a_long_cell_does_not_widen_its_column():
    article = "word " * 4000
    page = f"<table><tr><td>{article}<td>side</tr>" + "".join(f"<tr><td>r{i}<td>v{i}" for i in range(1000)) + "</table>"
    out = page_text(page)
    assert len(out) < 2 * len(page) and out.split() == [*article.split(), "side", *[w for i in range(1000) for w in (f"r{i}", f"v{i}")]]


def test_padding_is_bounded():
    wide = "<tr>" + f"<td>{'x' * 100}" * 1000
    page = f"<table>{wide}" + "<tr><td colspan=999><td>y" * 2000 + "</table>"
    out = page_text(page)
    assert len(out) < 10 * len(page) and out.count("y") == 2000 and out.count("x" * 100) == 1000


TAGS = ["p", "div", "b", "i", "ul", "li", "table", "tr", "td", "section", "h1", "blockquote", "span"]
MESS = st.lists(
    st.sampled_from([*[f"<{t}>" for t in TAGS], *[f"</{t}>" for t in TAGS], "<td rowspan=", "<ol start='", "colspan=²", '"', "'", "=", ">", "<", "/", " ", "x", "0", "<!--", "-->", "<pre>", "<svg>", "<select><option>", "&#", "²"]),
    max_size=60,
)


@settings(max_examples=300, deadline=None)
@given(MESS)
def test_no_page_raises(parts):
    assert isinstance(page_text("".join(parts)), str)


class Words(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_data(self, data):
        self.found += data.split()


def well_formed(depth):
    attributes = st.sampled_from(["", " class=\"a > 'b'\"", " title='say \"x\"'", " data-x=it's", " lang = en"])
    text = st.text("abc &<>\"' é", min_size=1, max_size=8).map(lambda t: f" {escape(t, quote=False)} ")
    if not depth:
        return text
    inner = st.lists(well_formed(depth - 1), max_size=3).map("".join)
    return st.one_of(text, st.builds(lambda t, a, x: f"<{t}{a}>{x}</{t}>", st.sampled_from(["div", "span", "section", "b", "blockquote"]), attributes, inner))


@settings(max_examples=200, deadline=None)
@given(well_formed(4))
def test_all_words_of_well_formed_pages(page):
    words = Words()
    words.feed(page)
    words.close()
    assert page_text(page).split() == words.found
