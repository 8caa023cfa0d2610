"""Main text: against the standard library's parser on the given pages, and on pages of other makes."""

import os
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from placegauge.llm import main_text, queries
from placegauge.llm.page_blocks import blocks, features

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
TREE = main_text.trained()


def text_of(page):
    return main_text.main_texts([page], TREE)[0]


class Article(HTMLParser):
    """Plain version for pages whose text is all that stands in their article element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.pieces = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1", "br", "article"):
            self.pieces.append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.pieces.append(data)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_same_text_as_a_plain_parser(spark):
    rows = queries.op13_main_text(spark, FOLDER).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for row in rows:
        plain = Article()
        plain.feed(pages[row.page_id].html)
        plain.close()
        assert row.text == " ".join("".join(plain.pieces).split())
        assert (row.url, row.n_chars) == (pages[row.page_id].url, len(row.text))


def test_the_tree_learns_its_table():
    for page, labels in main_text.example_pages():
        shares = TREE.shares(features(blocks(page)))
        assert sum((s >= 0.5) != label for s, label in zip(shares, labels, strict=True)) <= 1


LONG = "The river rose again in the night and by morning the lower fields were under water. " * 3
NEXT = "Farmers along the valley had moved their animals to the hills two days before that. " * 2
L, N = LONG.strip(), NEXT.strip()

OTHERS = {
    "article with everything around it": (
        f"""<html><body><header class="site-header"><h1>Valley News</h1><nav><a href="/">Home</a>
        <a href="/s">Sport</a></nav></header><div id="cookie-banner"><p>We use cookies to make this
        site work better for you. Accept them all or choose.</p></div><main><article><h1>The flood</h1>
        <p>{L}</p><p>Rain.</p><div class="advertisement"><p>Buy boots now, they are cheap and dry.</p>
        </div><h2>What is next</h2><p>{N}</p><ul><li>Pumps</li><li>Sandbags and ropes.</li></ul>
        </article><section id="comments"><h3>Comments</h3><article><p>{N} says a reader who was there
        and saw all of it.</p></article></section></main><aside><p>{N}</p></aside><form><p>Sign up for
        our letter.</p><label>Mail</label></form><footer><p>&copy; 2020 Valley News</p></footer>""",
        f"The flood {L} Rain. What is next {N} Pumps Sandbags and ropes.",
    ),
    "named containers": (
        f"""<body><div class="navbar"><a href=a>One</a> <a href=b>Two</a></div><div class="wrap
        with-columns"><div class="post-content"><h1>Title here</h1><p>{L}</p><p>No.</p><div>{N}</div>
        <div class="share-buttons"><a href=f>Post it</a></div></div><div class="sidebar"><h3>Latest</h3>
        <p>{N}</p></div><div class="comment-list"><p>{L}</p></div></div>
        <div id="footer">All rights reserved.</div>""",
        f"Title here {L} No. {N}",
    ),
    "no names at all": (
        f"""<table><tr><td><a href=a>Home</a> | <a href=b>News</a> | <a href=c>Sport</a></td></tr></table>
        <div><p>{L}</p><p>Still it rains.</p><p>{N}</p></div><div><a href=x>About</a> <a href=y>Imprint
        </a></div><div>&copy; 2021 somebody</div>""",
        f"{L} Still it rains. {N}",
    ),
    "an article without an end": (f"<nav><a href=x>Home</a></nav><article><p>{L}<p>{N}", f"{L} {N}"),
    "a form around all": (
        f"<form id=aspnet><div class=menu><a href=x>A</a></div><article><p>{L}</p></article></form>", L
    ),
    "a hidden part": (f"<article><p>{L}</p><div style='display: none'><p>{N}</p></div></article>", L),
}


@pytest.mark.parametrize("name", OTHERS)
def test_pages_of_other_makes(name):
    page, wanted = OTHERS[name]
    assert text_of(page) == wanted


def body(page):
    return [b.text for b in blocks(page)]


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        (None, []),
        ("", []),
        (" \n ", []),
        ("plain  text", ["plain text"]),
        ("a &amp; b &lt;p&gt; &eacute;&#233;&#xe9; &nbsp; &unknown; &amp", ["a & b <p> ééé &unknown; &"]),
        ("1 < 2 <3 <<b>x</b>", ["1 < 2 <3 <x"]),
        ("in<b>li</b>ne <i>text</i>", ["inline text"]),
        ("one<br>two<p>three<div>four</div>five", ["one two", "three", "four", "five"]),
        ("a<!-- <p>no</p> -->b<!---->c<!-->d", ["abcd"]),
        ("a<!-- never closed <p>b", ["a"]),
        ("<script>var t = '</p><p>x';</script>y<STYLE>p{}</STYLE >z", ["yz"]),
        ("a<script>never closed <p>b", ["a"]),
        ("a<noscript>off</noscript>b<noscript>open<p>c", ["abopen", "c"]),
        ('<p title="a > b" x=\'>\'>t</p>', ["t"]),
        ('<p title="open>t</p><p>u</p>', ["t", "u"]),
        ("<p", []),
        ("<!DOCTYPE html><?xml version='1'?></>x</ p>y", ["xy"]),
        ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]),
    ],
)
def test_broken_and_odd_markup(page, wanted):
    assert body(page) == wanted


def test_links_end_with_their_container():
    found = blocks("<div><a href=x>one two</div><p>three <a>four</a> five</p>")
    assert [(b.words, b.linked) for b in found] == [(2, 2), (3, 1)]


def test_very_long_and_very_broken_pages():
    words = " ".join(f"w{k}" for k in range(200_000))
    assert text_of(f"<article><p>{words}</p></article>") == words
    for piece in ("<div>", "</div>", "<a href=\"", "<!--", "<p class='", "<", "&", "<article>", "<aside>"):
        blocks(piece * 100_000)


def test_awkward_rows_and_clashing_columns(spark):
    page = f"<article><p>{L}</p></article>"
    rows = [(1, page), (1, page), (None, page), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "page_id long, html string")
    for name in ("text", "words", "mark", "linked"):
        df = df.withColumn(name, F.lit("own"))
    got = main_text.extracted(df)
    assert got.columns == ["page_id", "words", "mark", "linked", "text"]
    assert sorted(map(repr, got.select("page_id", "words", "text").collect())) == sorted(
        map(repr, [type(got.first())(page_id=k, words="own", text=t) for k, t in
                   [(1, L), (1, L), (None, L), (2, ""), (3, "")]])
    )
    assert main_text.extracted(df.limit(0)).collect() == []
