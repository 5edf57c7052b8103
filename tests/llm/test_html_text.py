import html
import re
import time

import pytest

from loamdex.llm.html_text import extract, main_text
from tests.llm.data import table

RICH = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body>
<header><h1>Site</h1><p>A long line in the page header that is not the article at all.</p></header>
<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><div class="cookie-notice"><p>We use cookies, and this is a long notice about them.</p></div>
<aside class="sidebar"><p>Related things that stand beside the article, quite long too.</p></aside>
<main><article><h1>Title &amp; more</h1><p>First   paragraph with\n a <b>bold</b> word&nbsp;and <a href="#">link</a>.<p>Short.<ul><li>item one<li>item two</ul>
<div class="ad">Buy now</div><form><p>Your name</p><input></form><p>Last &lt;paragraph&gt;.</p></article>
<section id="comments"><p>I am a reader and this is what I have to say about it.</p></section></main><footer><p>&copy; all of us, forever and ever.</p></footer></body></html>"""


def test_rich_page():
    assert main_text(RICH).split("\n") == ["Title & more", "First paragraph with a bold word and link.", "Short.", "item one", "item two", "Last <paragraph>."]


def test_page_without_article():
    page = "<body><div id=menu><a>Home</a></div><div><h2>Head</h2>" + "<p>A paragraph of some length, with words in it.</p>" * 3 + "<p>End.</p></div><div class=footer>foot</div>"
    assert main_text(page).split("\n") == ["Head", *["A paragraph of some length, with words in it."] * 3, "End."]


def test_edges():
    assert main_text(None) == main_text("") == main_text("<p> </p><script>x") == ""
    assert main_text("<![foo[bar]]>x") == "x" and main_text("a <![ b") == "a" and main_text("<p>a < b</p><p>c <a hre") == "a < b\nc"
    assert main_text("x " + "<a " * 30_000) == "x"
    assert main_text("only text &am") == "only text &am"
    assert main_text("<div class=ad>unclosed<article><p>x y</p>") == "x y"
    assert main_text("<article><p>a" + "<b>" * 3000 + "b") == "ab"


STORY = "<p>The story has a long first paragraph, and it goes on for a while.</p><p>Then there is a second one, which is long too.</p>"
TOLD = "The story has a long first paragraph, and it goes on for a while.\nThen there is a second one, which is long too."


def test_articles_in_boilerplate():
    page = f'<body><article>{STORY}</article><aside class="related"><article>Teaser of another story</article></aside><div id="comments"><article>I think this comment is longer than the whole story, so I go on and on and on and on and on, and on, and on, and on, and on, and on, and on.</article></div></body>'
    assert main_text(page) == TOLD


def test_main_article_among_several():
    teasers = "<article><h2>Other news</h2><p>A few words of it.</p></article>" * 3
    assert main_text(f"<main>{teasers}<article>{STORY}</article>{teasers}</main>") == TOLD
    assert main_text(f"<main><h1>Head</h1><article>{STORY}<article><p>A reader's reply.</p></article></article></main>") == f"Head\n{TOLD}"
    assert main_text(f"<div>{STORY * 4}</div><div><article>Teaser</article></div>") == "\n".join([TOLD] * 4)


def test_links_alone():
    links = "<ul><li><a href=/1>One more story</a><li><a href=/2>And one more</a></ul>"
    assert main_text(f"<article>{STORY}{links}{STORY}<p>See <a href=/x>this</a> as well.</p></article>") == f"{TOLD}\n{TOLD}\nSee this as well."


def test_headers_and_marks_in_articles():
    page = f'<body class="header-fixed"><article class="post has-comments"><div class="header"><h1>Title</h1><p>By Ann</p></div><header><p>Lead</p></header>{STORY}<div class="share">Share it</div></article>'
    assert main_text(page) == f"Title\nBy Ann\nLead\n{TOLD}"


LONG = "A block of plain text with enough words in it to be a paragraph of its own, number"


def test_no_block_goes_by_its_neighbours():
    page = f"<body><div><p>{LONG} one.</p></div><div><p>Short.</p></div><div><p>{LONG} two.</p></div><div><a href=/1>x</a> <a href=/2>y</a> <a href=/3>z</a></div></body>"
    out = main_text(page).split("\n")
    assert f"{LONG} one." in out and f"{LONG} two." in out and "x y z" not in out


def test_marks_that_are_only_part_of_a_word():
    page = f'<article>{STORY}<section id="related-work"><h2>Related work</h2><p>{LONG} one.</p></section><div class="social-history"><p>{LONG} two.</p></div>{STORY}</article>'
    assert main_text(page).split("\n") == [*TOLD.split("\n"), "Related work", f"{LONG} one.", f"{LONG} two.", *TOLD.split("\n")]
    for mark in ("commentlist", "relatedPosts", "share-buttons", "cookie_notice", "ad-container-2", "related-posts", "related-teasers-foo"):
        extra = "<p><a href=/1>Another story</a></p>" if "foo" in mark else "<p>What a reader says about it.</p>"
        assert main_text(f'<article>{STORY}<div class="{mark}">{extra}</div></article>') == TOLD, mark


def test_parts_of_a_digest():
    page = f"<article><h1>Digest</h1><article>{STORY}</article><article><h2>Other</h2><p>{LONG} two.</p></article></article>"
    assert main_text(page).split("\n") == ["Digest", *TOLD.split("\n"), "Other", f"{LONG} two."]


@pytest.mark.parametrize("make", [
    lambda n: "<b>" * n + "x" + "</i>" * n, lambda n: "<b>" * n + "<p>x" * n, lambda n: "<i><article>" + "<b>" * n + "</i>" * n, lambda n: "<ul><b>" + "<li><i>" * n,
    lambda n: "<b>" * n + "</b>" * n + "x", lambda n: "<div>" * n + "x", lambda n: "<a>" * n + "<td>x" * n, lambda n: "<article>" * n + "x",
])
def test_ill_nested_pages_take_linear_time(make):
    page = make(100_000)
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 4


def plain(page: str) -> str:
    """The article of the test tables' simple pages, by string operations."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", body))
    return "\n".join(x for b in blocks if (x := " ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split())))


def test_pages_match_their_plain_reading(spark):
    rows = extract(table(spark, "pages").withColumnRenamed("html", "html")).join(table(spark, "pages").select("page_id", "html"), "page_id").collect()
    assert len(rows) == table(spark, "pages").count() > 0
    for row in rows:
        assert row.text == plain(row.html)
        assert row.n_chars == len(row.text)


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<p>hi", "t")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, extract(pages).collect()), key=str) == [(1, "u", "", 0), (1, "u", "", 0), (None, None, "hi", 2)]
    assert extract(pages.limit(0)).count() == 0
