import html as entities

import pytest

from cases import CLASHING
from usageloom.llm import html_text
from usageloom.llm.html_text import main_text

LONG = "The house on the hill was built by a family of the town, and it is one of the places that people know for its view. " * 2
LONG = LONG.strip()
GERMAN = ("Das Haus auf dem Berg ist von einer Familie aus der Stadt gebaut, und es ist nicht das einzige, das man von weit sieht. " * 2).strip()
MENU = '<nav><ul><li><a href="/a">The start</a><li><a href="/b">All of the news</a></ul></nav>'


def page(body, head="<title>The title of it</title><style>p{}</style><script>var x='<p>no</p>'</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_article_without_its_surroundings():
    body = (
        f"<header class='site'><h1>Site of the day</h1>{MENU}</header><!-- ad <p>x</p> --><div class='ad'>{LONG}</div>"
        f"<article><header><h1>A head &amp; more</h1></header><p>{LONG}</p><p>Yes.</p><p>Qwrt zxcv.</p><h2>Next</h2><p>{GERMAN}"
        f"<aside>{LONG}</aside><form><p>{LONG}</p><input></form><div class='share-buttons'>Share this</div></article>"
        f"<section id='comments'><article class='comment'><p>{LONG}</p></article></section>"
        f"<div class='cookieNotice'>{LONG}</div><aside>{LONG}</aside><footer>&copy; 2024 {LONG}</footer>"
    )
    want = ["A head & more", LONG, "Yes.", "Qwrt zxcv.", "Next", GERMAN]
    assert main_text(page(body)) == "\n\n".join(want)


def test_plain_divisions_are_told_by_density_and_neighbours():
    body = (
        f"<div><a href=/>Home</a> | <a href=/n>News</a></div><div><h1>Heading here</h1><div>{LONG}</div><div>Short one.</div>"
        f"<div>{LONG}</div></div><div><a href=/1>{LONG}</a></div><div>Copyright © of the site</div>"
    )
    assert main_text(page(body)) == "\n\n".join(["Heading here", LONG, "Short one.", LONG])


def test_a_heading_follows_what_comes_after_it():
    body = f"<p>{LONG}</p><h3>Of more</h3><ul><li><a href=1>{LONG}</a><li><a href=2>{LONG}</a></ul>"
    assert main_text(page(body)) == LONG


def test_different_neighbours_decide_by_distance():
    bad = f"<div><a href=/1>{LONG}</a></div>"
    assert main_text(page(f"<div>{LONG}</div><div>One.</div><div>Two.</div>{bad}")) == LONG + "\n\nOne."


@pytest.mark.parametrize(
    "written, want",
    [
        ("a &lt; b &amp;&amp; c &am &copy &#8364; &#x41; &nosuch;", "a < b && c &am © € A &nosuch;"),
        ("one<br>two<br/>three", "one two three"),
        (" a \n\t b&nbsp; c d ", "a b c d"),
        ("x <b>y</b>z<i>w</i>", "x yzw"),
        ("a <3 b < c", "a <3 b < c"),
        ("left<!-- gone > here --> right", "left right"),
        ("left<script>if (a < b) { '</p>' }</script> right", "left right"),
        ('<a title="1 > 0" href=\'x>y\'>see</a> it', "see it"),
        ("日本語の文章です。", "日本語の文章です。"),
    ],
)
def test_text_of_a_block(written, want):
    assert main_text(page(f"<article><p>{written}</p><p>{LONG}</p></article>")) == f"{want}\n\n{LONG}"


def test_broken_pages():
    assert main_text("") == ""
    assert main_text("just words") == "just words"
    assert main_text(f"<article><p>{LONG}<p>cut off <b") == f"{LONG}\n\ncut off"
    assert main_text(f"<article><p><b>{LONG}<br><p>next</p></article><footer>{LONG}") == f"{LONG}\n\nnext"
    assert main_text(page(f"<nav>menu</div></p></nav><main><p>{LONG}</main></main></div>")) == LONG
    assert main_text(page(f"<form id=all>{MENU}<main><p>{LONG}</p></main></form>")) == LONG
    assert main_text("<article>" + "<b>" * 5000 + "deep</article>" + "</b>" * 5000) == "deep"
    assert main_text("<script>" + "<p>x" * 1000) == ""


def test_page_without_decided_blocks():
    assert main_text(page("<div>Qwrt zxcv.</div><div>Bnmq.</div>")) == "Qwrt zxcv.\n\nBnmq."
    assert main_text(page("<div>Qwrt zxcv.</div><article><p>Bnmq.</article>")) == "Bnmq."


def test_work_is_linear():
    import time

    def seconds(n):
        text = page("<article>" + ("<p>" + "<b>" * 3 + 'a <a href="' + "x" * 9 + "'>" + LONG) * n)
        started = time.process_time()
        main_text(text)
        return time.process_time() - started

    seconds(50)
    assert seconds(1600) < 12 * max(seconds(200), 0.01)


def test_query_equals_the_article_of_each_page(spark):
    """The pages of the test tables hold their article in one element, with paragraphs and one heading."""
    import re

    from usageloom.llm import queries

    sf = "/root/testdata/sf0.01"
    found = {r.page_id: r for r in queries.op13_html_extraction(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(found) == len(pages)
    for p in pages:
        inner = p.html.split("<article>")[1].split("</article>")[0].replace("<br>", " ").replace("<b>", "")
        pieces = [" ".join(entities.unescape(x).split()) for x in re.split("</?(?:p|h1)>", inner)]
        want = "\n\n".join(x for x in pieces if x)
        assert (found[p.page_id].text, found[p.page_id].n_chars, found[p.page_id].url) == (want, len(want), p.url)


def test_tables(spark):
    names = [c for c in CLASHING]
    rows = [(i, h, *["k"] * len(names)) for i, h in enumerate([None, "", page(f"<p>{LONG}</p>"), page(f"<p>{LONG}</p>")])]
    schema = "page_id long, html string" + "".join(f", `{c}` string" for c in names)
    out = html_text.with_main_text(spark.createDataFrame(rows, schema))
    assert out.columns == ["page_id", *names, "text"]
    assert [r.text for r in out.orderBy("page_id").collect()] == ["", "", LONG, LONG]
    assert html_text.with_main_text(spark.createDataFrame([], schema)).collect() == []
