import os
import time

import pytest

from folioscope.llm import html_text

TREE = html_text.default_tree()


def text(source):
    return html_text.main_text(source, TREE)


PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="top"><a href="/">Site</a> name</header><nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav>
<!-- ad --><div class="ad">Buy these nice things now today.</div><div id="cookie-notice">We use cookies here.</div>
<article><h1>The &eacute;t&eacute;</h1><p><b>First&nbsp;one.<br>goes  on
</p><p>Short.</p><ul><li>item <a href=x>link</a></li></ul><div class="share-buttons">Share this</div>
<section class="comments"><p>I liked it very much indeed, thank you.</p></section><p>a &lt;b&gt; &amp;amp; c<p>Last</article>
<aside>More to read about all of this.</aside><form>Your mail<input><button>Go</button></form><footer>&copy; all</footer></body></html>"""


def test_page():
    assert text(PAGE).split("\n\n") == ["The été", "First one. goes on", "Short.", "item link", "a <b> &amp; c", "Last"]


def test_short_end_before_links():
    page = "<article><p>One two three four.</p><p>The end.</p></article><ul><li><a href=a>A</a></ul>"
    assert text(page).split("\n\n") == ["One two three four.", "The end."]


def test_without_article():
    words = "word " * 40
    page = f"<body><ul><li><a href=a>A</a><li><a href=b>B</a></ul><h2>Head line here</h2><div>{words}</div><p>{words}</p><div><a href=x>next page</a></div>"
    assert text(page).split("\n\n") == ["Head line here", words.strip(), words.strip()]


@pytest.mark.parametrize("source", [None, "", " \n", "<", "<p", "<!-- x", "<script>x", "<article><p", "</p></div>", "<style>"])
def test_empty(source):
    assert text(source) in ("", "<")


def test_cut_off_and_bare():
    assert text("<article><p>some text that is &am") == "some text that is &am"
    assert text("<article>1 < 2 and 3 > 2</article>") == "1 < 2 and 3 > 2"


@pytest.mark.parametrize("source", ["<a" * 100_000, "<!--" * 100_000, "<div>" * 50_000 + "x", "<p>" * 100_000, "<script>" * 50_000, "<article>" + "x " * 500_000])
def test_long_pages_take_linear_time(source):
    began = time.time()
    text(source)
    assert time.time() - began < 5


def test_tree_fits_its_pages():
    x, y = html_text.labelled_blocks()
    assert ((html_text.predict(TREE, x) >= 0.5) == y).mean() > 0.95


def test_no_feature_decides_alone():
    """Neither names nor elements, at their best cut, come near to what the grown tree does."""
    x, y = html_text.labelled_blocks()
    right = ((html_text.predict(TREE, x) >= 0.5) == y).mean()
    for f in range(x.shape[1]):
        alone = html_text.grow(x[:, [f]], y, depth=1)
        assert ((html_text.predict(alone, x[:, [f]]) >= 0.5) == y).mean() < right - 0.05

    def used(node):
        return set() if node.left is None else {html_text.FEATURES[node.feature]} | used(node.left) | used(node.right)

    assert {"link_density", "in_article", "element", "share"} <= used(TREE) and used(TREE) & {"links_before", "links_after"}


LONG = "word " * 40


@pytest.mark.parametrize(
    "page, want",
    [
        ('<article><p title="a < b">Hello there</p><p data-x=\'<i>\'>and more</p></article>', ["Hello there", "and more"]),
        (f'<article><h2 class="section-header">Facts</h2><p>{LONG}</p><div class="legal"><p>The court held that this is so.</div></article>', ["Facts", LONG.strip(), "The court held that this is so."]),
        (f'<div class="content with-sidebar"><h1>Head line</h1><p>{LONG}</p><p>{LONG}</p></div><div class="sidebar">Some other pages here</div>', ["Head line", LONG.strip(), LONG.strip()]),
        (f'<div id="side-effects"><p>{LONG}</p><p>{LONG}</p></div>', [LONG.strip()] * 2),
        (f'<div class="search-engines"><p>{LONG}</p><p>{LONG}</p></div>', [LONG.strip()] * 2),
        (f'<div class="main"><p>{LONG}</p><blockquote>Five words of a man.</blockquote><p>{LONG}</p></div>', [LONG.strip(), "Five words of a man.", LONG.strip()]),
        ("<body><p>A short paragraph.</p></body>", ["A short paragraph."]),
        ("<nav><a>One</a></nav><footer>All of it is ours and yours and theirs.</footer>", []),
        (f'<article><p>{LONG}</p><div class="comments"><p>{LONG}</p></div></article>', [LONG.strip()]),
    ],
)
def test_shapes_of_pages(page, want):
    assert [x for x in text(page).split("\n\n") if x] == want


def test_given_pages():
    """Every block of the given pages that stands in their article, and no other."""
    duckdb = pytest.importorskip("duckdb")
    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    for (page,) in duckdb.sql(f"SELECT html FROM '{path}'").fetchall():
        inside = [b.text for b in html_text.blocks_of(page) if b.in_article]
        assert text(page) == "\n\n".join(inside)


def test_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None)], "page_id long, url string, html string")
    got = html_text.extracted(df).collect()
    assert [r.n_chars for r in got] == [len(text(PAGE))] * 2 + [0] and got[2].text == ""
    assert html_text.extracted(df.where("page_id > 5")).count() == 0


def test_quoted_values_may_hold_the_end_of_a_tag():
    page = """<article><p title="a > b">Hello there, this is a paragraph of words.</p><p data-x='1 > 0' class=it's>Second one, don't cut it here please.</p><a href="open>not closed</a></article>"""
    blocks = html_text.blocks_of(page)
    assert [b.text for b in blocks][:2] == ["Hello there, this is a paragraph of words.", "Second one, don't cut it here please."]
    assert blocks[2].text == "not closed"


def test_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "<article><p>One two three four five six.</p></article>", "x", 7)], "page_id long, html string, Text string, N_chars int")
    out = html_text.extracted(df)
    assert out.columns == ["page_id", "text", "n_chars"] and out.first().text == "One two three four five six."
    assert html_text.extracted(df.where("page_id > 1")).count() == 0
