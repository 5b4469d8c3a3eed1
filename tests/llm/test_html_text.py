"""Main-text extraction: whole fixture pages and hand-written ones."""

import html
import re

import pytest

from cspulse.llm import html_text

NOISE = ("<header>Site <h1>Name</h1></header><nav><ul><li><a href=/>Home</a><li>About</ul></nav>"
         "<div class='cookie-notice'>We use cookies, a lot of them, really, and you agree.</div>")
TAIL = ("<div id=comments><p>Great text, I liked it, very, very much, and so will you.</p></div>"
        "<aside><p>Related: other things.</p></aside><form><p>Subscribe, please.</p></form><footer>End</footer>")


@pytest.mark.parametrize("page,expected", [
    (None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("plain", "plain"),
    (f"<html><body>{NOISE}<article><h1>Title</h1><p>One, two.</p><p>Three.</p></article>{TAIL}</body></html>",
     "Title\nOne, two.\nThree."),
    (f"<body>{NOISE}<div id=main><h2>Head</h2><p>First long sentence, with marks.<p>Second<br>line.</div>{TAIL}",
     "Head\nFirst long sentence, with marks.\nSecond line."),
    ("<article><p>A &amp; B &lt;c&gt; &#233; &eacute; &nbsp;x</p></article>", "A & B <c> é é x"),
    ("<article><p>a<b>b</b><i> c</i>d</p>tail <script>var x='</p>';</script>text</article>", "ab cd\ntail\ntext"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "one\ntwo\nx\ny"),
    ("<article><header><h1>Kept</h1></header><p>Body text, here.</p></article>", "Kept\nBody text, here."),
    ("<article><p>a < b</p><!-- c --><p>d<!--> e</p><![CDATA[f]]></article>", "a < b\nd e"),
    ("<article><p>cut off in a tag</p><p>more text<a hre", "cut off in a tag\nmore text"),
    ("<div class='page with-sidebar'><article><div class=article-header><h1>T</h1></div><p>Body, text.</p>"
     "</article><div class='left sidebar'><p>Side, text, and more of it.</p></div></div>", "T\nBody, text."),
    ("<style>p{}</style><article><p>One.</p><div class=\"ad\">Buy, buy, buy!</div><p>Two.</p></article>",
     "One.\nTwo."),
])
def test_pages(page, expected):
    assert html_text.main_text(page) == expected


LONG = "A long sentence, with marks, and words. " * 6
BIG = f"<p>{LONG}</p>" * 4
BIG_TEXT = "\n".join([LONG.strip()] * 4)
ENTRY = "Long entry, with words, and more."


@pytest.mark.parametrize("page,expected", [
    (f"<article><h1>T</h1><p>lead</p><div class=content>{BIG}</div></article>", f"T\nlead\n{BIG_TEXT}"),
    (f"<body><div><h1>T</h1><p>lead</p><div class=content>{BIG}</div></div>"
     "<div><ul><li><a href=/>Home</a><li><a href=/o>Off</a></ul></div></body>", f"T\nlead\n{BIG_TEXT}"),
    (f"<p>intro</p><ul>{f'<li>{ENTRY}' * 9}</ul><p>outro</p>", "\n".join(["intro", *[ENTRY] * 9, "outro"])),
    (f"<h2>a</h2><section>{BIG}</section><section><p>short</p></section>", f"a\n{BIG_TEXT}\nshort"),
    (f"<p>intro</p><blockquote>{BIG}</blockquote><p>outro</p>", f"intro\n{BIG_TEXT}\noutro"),
    (f"<p>intro</p><table><tr><td>{BIG}<td>x</table><p>outro</p>", f"intro\n{BIG_TEXT}\nx\noutro"),
    (f"<div>{BIG}</div><div><p>short</p></div>", f"{BIG_TEXT}\nshort"),
    (f"<main><h1>T</h1><article>{BIG}</article><p>end</p></main>{TAIL}", f"T\n{BIG_TEXT}\nend"),
    (f"<article>{BIG}</article><article><p>Second, short.</p></article>", f"{BIG_TEXT}\nSecond, short."),
])
def test_nothing_beside_the_big_part_is_lost(page, expected):
    assert html_text.main_text(page) == expected


@pytest.mark.parametrize("page,expected", [
    (f"<article>{BIG}<h2 id='related-work'>R</h2><section id='discussion'><p>Short.</p></section>"
     f"<h2 id='legal'>L</h2><p class='notice'>Note.</p><div class=ad>Buy!</div></article>{TAIL}",
     f"{BIG_TEXT}\nR\nShort.\nL\nNote."),
    (f"<div class='left-sidebar'><div class=sidebar><p>Side, text.</p></div><article>{BIG}</article>{TAIL}</div>",
     BIG_TEXT),
    (f"<div class='sidebar-layout'><div class=sidebar><p>Side, text.</p></div><div>{BIG}</div></div>", BIG_TEXT),
    (f"<main><article>{BIG}</article><div id=comments><ol><li><article>{BIG * 2}</article></ol></div></main>",
     BIG_TEXT),
    (f"<div class='widget-page'><main>{BIG}</main></div><div class='related'><p>Other, text.</p></div>", BIG_TEXT),
    (f"<h1 class='page-header'>T</h1><div>{BIG}</div>{TAIL}", f"T\n{BIG_TEXT}"),
])
def test_names_leave_out_no_part_of_the_article(page, expected):
    assert html_text.main_text(page) == expected


LINKS = "<li><a href=/a>One other story</a><li><a href=/b>Another story</a>"


@pytest.mark.parametrize("page,expected", [
    (f"<article>{BIG}<p class='cookie-notice'>We use cookies, and more.</p><p>End.</p></article>", f"{BIG_TEXT}\nEnd."),
    (f"<article><ul class=share>{LINKS}</ul>{BIG}</article>", BIG_TEXT),
    (f"<article>{BIG}<section class='related'><h2>Related</h2><ul>{LINKS}</ul></section><p>End.</p></article>",
     f"{BIG_TEXT}\nEnd."),
    (f"<article>{BIG}<h2>Related stories</h2><ul id=related>{LINKS}</ul></article>", BIG_TEXT),
    (f"<article>{BIG}<section class='related'><p>Other, text.</p></section><p class=ad>Buy!</p></article>", BIG_TEXT),
    (f"<article>{BIG}<p style='color: red; display : none'>Unseen.</p><b style=visibility:hidden>x</b></article>",
     BIG_TEXT),
    (f"<body style='display:none'><article style='display:none'>{BIG}</article></body>", BIG_TEXT),
    (f"<div><div>{BIG}</div><h3>3 Comments</h3><ol class=commentlist><li>Good, very good.</ol></div>", BIG_TEXT),
    (f"<div><div>{BIG}</div><h3>Results</h3><div class=ad>Buy!</div><p>Text, more.</p></div>",
     f"{BIG_TEXT}\nResults\nText, more."),
    (f"<main><article>{BIG}</article><section class=related><ul>{LINKS}</ul></section></main>", BIG_TEXT),
    # An ordinary section of such a name, in the middle or long, stays.
    (f"<article>{BIG}<section class='navigation'><p>Short.</p></section><p>End.</p></article>",
     f"{BIG_TEXT}\nShort.\nEnd."),
    (f"<article>{BIG}<section class='navigation'>{BIG}</section></article>", f"{BIG_TEXT}\n{BIG_TEXT}"),
    (f"<article>{BIG}<section id='promotion'><p>Short.</p></section></article>", f"{BIG_TEXT}\nShort."),
])
def test_boilerplate_inside_articles_goes(page, expected):
    assert html_text.main_text(page) == expected


def test_fixture_pages(spark):
    """The article's blocks, worked out by plain patterns for this generator's pages."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = html_text.extract(pages).select("page_id", "html", "text", "n_chars").collect()
    assert len(got) == pages.count()
    for r in got:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = re.split(r"<p>|</p>|</?h1>", re.sub(r"</?b>", "", re.sub(r"<footer>.*", "", article, flags=re.S)))
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in blocks]
        assert r.text == "\n".join(b for b in blocks if b), r.page_id
        assert r.n_chars == len(r.text)


def test_very_long_and_deep_pages():
    deep = "<div>" * 3000 + "<p>Deep text, here.</p>"
    assert html_text.main_text(deep) == "Deep text, here."
    deeper = "<x>" * 60_000 + "</y>" * 60_000 + "<p>End, at last.</p>" + "</x>" * 60_000 + "</p>" * 60_000
    assert html_text.main_text(deeper) == "End, at last."
    many = "<div><x>" * 20_000 + "<div>t, u</div>" * 20_000
    assert html_text.main_text(many).count("t, u") == 20_000
    named = "<main>" + "<section class=share>" * 20_000 + "x, y" + "</section>" * 20_000 + f"{BIG}</main>"
    assert html_text.main_text(named).endswith(BIG_TEXT)
    tails = f"<main>{BIG}" + "<section class=share>x, y</section>" * 20_000 + "</main>"
    assert html_text.main_text(tails).startswith(BIG_TEXT)
    long_page = "<article>" + "<p>Some text, and more.</p>" * 50_000 + "</article>"
    assert html_text.main_text(long_page).count("\n") == 49_999


def test_edge_rows(spark):
    rows = [(1, None, "a"), (None, "<p>x</p>", "b"), (1, "<p>x</p>", "b"), (1, "<p>x</p>", "b")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [
        ("1", "", 0), ("1", "x", 1), ("1", "x", 1), ("None", "x", 1)]
    assert html_text.extract(pages.where("false")).count() == 0
