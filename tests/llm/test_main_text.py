import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuspack.llm.common import pages as read_pages
from corpuspack.llm.main_text import extract, main_text
from corpuspack.llm.queries import op6_line_block_text
from tests.conftest import SF_SMALL

LONG = "This is a fairly long sentence of the article body with many plain words in it, to be kept whole."


def test_query_against_the_articles(spark):
    """The pages' articles, read with a plain expression."""
    rows = {r["page_id"]: r for r in op6_line_block_text(spark, SF_SMALL).collect()}
    pages = read_pages(spark, SF_SMALL).collect()
    assert len(rows) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)(</article>|\Z)", p["html"], re.DOTALL)[1]
        article = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>|<[/a-z]*$", "\0", article))
        lines = [" ".join(html.unescape(line).split()) for line in article.split("\0")]
        text = "\n".join(line for line in lines if line)
        assert (rows[p["page_id"]]["text"], rows[p["page_id"]]["n_chars"], rows[p["page_id"]]["url"]) == (text, len(text), p["url"])


@pytest.mark.parametrize(("page", "text"), [
    (f"<div class=top><a href=/>Home</a> <a href=/a>About</a></div><div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div>"
     f"<div><h2>Title here</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div>Copyright 2020</div>", f"Title here\n{LONG}\nShort.\n{LONG}"),
    (f"<header><h1>Site</h1></header><main><h1>T</h1><p>{LONG}</p><aside>Side</aside><div class='ad-box'>Buy</div><p>End &amp; so on.</p>"
     f"<section id=comments><p>{LONG}</p></section></main><footer>f</footer>", f"T\n{LONG}\nEnd & so on."),
    (f"<form id=all><nav>menu</nav><article><header><h1>Head</h1></header>{LONG}<br>two</article></form>", f"Head\n{LONG}\ntwo"),
    (f"<div id='cookie-notice'><p>{LONG}</p></div><div class=content><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div>", LONG),
    (f"<article><h1>A</h1><p>{LONG}</p><article class=comment><p>reader</p></article></article>", f"A\n{LONG}"),
    ("<article><p title='a>b'>x &lt;y&gt; &#8364; &nbsp; z</p><script>if(a<b)w('<p>no</p>')</script></article>", "x <y> € z"),
    ("<article><p>x</p><!-- <p>no</p> --><p>y <b>bo\n ld</b></p><p>cut &am", "x\ny bo ld\ncut &am"),
    ("<article><p>a</p><p <nav>b", "a\nb"), ("<nav>never closed <article><p>kept</p></article>", "kept"),
    ("just text < 5 and > 3", "just text < 5 and > 3"), ("", ""), (None, ""), ("<p>", ""),
])
def test_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(("page", "text"), [
    (f"<article><section id='related-work'><h2 id='social-costs'>Costs</h2><p class='ad-hoc'>{LONG}</p></section><h3 id='search-results'>Found</h3><p class=share>x</p></article>", f"Costs\n{LONG}\nFound\nx"),
    ("<article><p>a</p><div class='share-buttons'>Share</div><ul id=comments><li>reader</ul><div class='post ads'>Buy</div><p>b</p></article>", "a\nb"),
    ("<article><p>a</p><svg><title>icon</title><path><p>b</p><iframe src=x><p>c</p></article>", "a\nb\nc"),
    ("<article><p>a <canvas>old</p><p>b</p><video src=x><p>c</p><svg/><p>d <svg><text>t</text></svg>e</p></article>", "a\nb\nc\nd\ne"),
])
def test_names_and_open_elements_take_no_text_of_the_article(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("name", ["social-costs", "search-results", "related-work", "top-story", "blog-post-content top", "main-header-text", "menu", "cookie-recipes", "shareholderNotice"])
def test_ordinary_names_round_the_whole_text(name):
    body = f"<h2 id='social-costs'>Costs</h2><p>{LONG}</p><section id='related-work'><p>{LONG}</p><p>Short.</p></section>"
    want = f"Costs\n{LONG}\n{LONG}\nShort."
    menu = "<ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul>"
    assert main_text(f"<body>{menu}<div class='{name}'>{body}</div></body>") == want
    assert main_text(f"<body>{menu}<main><div class='{name}'>{body}</div></main></body>") == want


@pytest.mark.parametrize("name", [
    "reader-comments", "user-comments", "post-comments", "comment-thread", "disqus_thread", "related-posts", "related-articles", "sidebar-left", "site-notice",
    "article-ad", "ad-unit-top", "inline-promo", "breadcrumb-trail", "newsletter-form-wrapper", "commentList", "pageSidebar", "cookie-banner", "share-buttons",
])
def test_what_the_contract_excludes(name):
    """In an article and without one, by class and by id, even with sentences."""
    extra = "<p>A reader wrote this whole sentence here, and it is no part of the text.</p>"
    for given in (f"class='{name}'", f"class='x {name}'", f"id={name}"):
        inner = f"<h1>T</h1><p>{LONG}</p><div {given}>{extra}</div><p>{LONG} Two.</p>"
        assert main_text(f"<article>{inner}</article>") == main_text(f"<body><div>{inner}</div></body>") == f"T\n{LONG}\n{LONG} Two."


def test_adverts_on_any_element_but_headings():
    page = f"<article><h2 class=ad>Of adverts</h2><p class=ad>Buy</p><p>a <span class='article-ad'>now</span> b</p><figure class=promo>x</figure><p class='ad-hoc share'>{LONG}</p></article>"
    assert main_text(page) == f"Of adverts\na\nb\n{LONG}"


def test_comments_longer_than_the_article():
    page = f"<article><h1>T</h1><p>{LONG}</p><div id=comments>{f'<p>{LONG} again</p>' * 9}</div></article>"
    assert main_text(page) == f"T\n{LONG}"


def test_imprints_are_no_sentences():
    for line in ("Copyright 2020 by Some Company and others.", "© 2020 The Company of many names.", "Advertisement: buy our fine shoes here today."):
        page = f"<body><section>{f'<p>{LONG}</p>' * 4}</section><section><p>{line}</p></section></body>"
        assert main_text(page) == "\n".join([LONG] * 4)


def test_lists_of_links_inside_an_article():
    links = "<ul>" + "".join(f"<li><a href={i}>Some other story {i}</a>" for i in range(5)) + "</ul>"
    assert main_text(f"<article><p>{LONG}</p>{links}<p>{LONG}</p><ul><li>one<li><a href=1>two</a><li>three</ul></article>") == f"{LONG}\n{LONG}\none\ntwo\nthree"


def test_time_grows_with_the_tags_only():
    import time

    def seconds(n):
        pages = [
            f"<article>{LONG}</article>" * n, "<div>" * n + LONG, f"<div class='x-{n} ad-box'><p>{LONG}</p></div>" * n, f"<section><p>Few words</p></section><div>{LONG}</div>" * n,
            "<div><p>A few words here.</p>" * n + LONG * 3 + "</div>" * n, "<article class=comment>x</article><nav>y</nav>" * n,
        ]
        out = []
        for page in pages:
            t = time.process_time()
            main_text(page)
            out.append(time.process_time() - t)
        return out

    seconds(50)
    for small, large in zip(seconds(5_000), seconds(50_000)):
        assert large < 40 * max(small, 0.02) and large < 30


def test_short_runs_of_the_text_are_kept():
    """Sections of one container, sections below the body, and a closing sentence; lists of links go."""
    menu = "<div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div>"
    sections = f"<section><h2>A</h2>{f'<p>{LONG}</p>' * 8}</section><section><h2>B</h2><p>Few words</p></section><ul><li>x</ul>"
    want = "\n".join(["A", *[LONG] * 8, "B", "Few words", "x"])
    assert main_text(f"<body>{menu}<div class=content>{sections}</div><div>Copyright 2020</div></body>") == want
    page = f"<body>{menu}<section>{f'<p>{LONG}</p>' * 8}</section><section><p>It ends with this line.</p></section>{menu}</body>"
    assert main_text(page) == "\n".join([*[LONG] * 8, "It ends with this line."])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<nav>", "</nav>", "<article>", "</article>", "<div class='ad'>", "</div>", "<", ">", "&am", "'", '"', "<!--", "-->", "<script>", "</script>", "word ", "\n", "é"]), max_size=40))
def test_no_page_is_an_error(parts):
    text = main_text("".join(parts))
    assert all(line == line.strip() and line for line in text.split("\n")) or text == ""


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, None, None, "c", "c"), (None, "u", "<article>x</article>", "c", "c"), (2, "u", "<p>y", None, None), (2, "u", "<p>y", None, None), (3, "u", "<article>" + "<p>long line</p>" * 60000, "c", "c")]
    got = extract(spark.createDataFrame(rows, schema)).collect()
    assert [(r["page_id"], r["url"], r["text"][:5], r["n_chars"]) for r in got] == [(1, None, "", 0), (None, "u", "x", 1), (2, "u", "y", 1), (2, "u", "y", 1), (3, "u", "long ", 599999)]
    assert extract(spark.createDataFrame([], schema)).count() == 0
