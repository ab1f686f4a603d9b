"""Main text by minimum cut."""

import html
import itertools
import random
import re

import pandas as pd

from sealwright.llm import extraction as ex, queries

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="home"><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class=sidebar><p>Links and a long enough sentence that is not the article at all.</p></div>
<div class="cookie-notice"><p>We use cookies to make this page better for you, dear reader.</p></div>
<article><h2>Title</h2><p>Hello &amp; <b>wor</b>ld   this is<br>text &lt;x&gt; in a paragraph.<p>Short.<p><blockquote>Quote&nbsp;it.</blockquote>
<ul><li>first point</li><li>second point</li></ul><div class="ad-banner">Buy now, buy here.</div><script>var t="</p>";</script>
<table><tr><td>a</td><td>b</td></tr></table></article>
<section id="comments"><h3>Comments</h3><p>I think that this is a very interesting story, long and so on.</p></section>
<form>Name <input><button>Send</button></form><aside>Related stories</aside><footer>&copy; me</footer></body></html>"""


def test_furniture_goes_and_the_article_stays():
    assert ex.main_text(PAGE).split("\n\n") == [
        "Title", "Hello & world this is text <x> in a paragraph.", "Short.", "Quote it.", "first point", "second point", "a", "b"]


def test_pages_without_markup_or_article():
    assert ex.main_text("plain &amp; simple") == "plain & simple"
    assert ex.main_text(None) == ex.main_text("") == ex.main_text("<nav>x</nav>") == ex.main_text("<p> <p>\n") == ""
    body = "<div><p>A paragraph of some length that reads like the text of a page.</p><p>And one more of them, long enough.</p></div>"
    assert ex.main_text(f"<div id=menu><a href=x>Home</a></div>{body}<div class=footer>All rights</div>").count("\n\n") == 1
    for broken in ("<p", "<p>a<", "a < b and c > d", "<!-- open", "<script>never closed", "</p></div>x", "<div class='a>b"):
        assert isinstance(ex.main_text(broken), str)


def test_only_hidden_elements_are_silent():
    text = "Words of a page that are long enough to be read as its text."
    for shown in ('style="overflow:hidden"', 'class="overflow-hidden"', 'class="hidden-print"', 'title="the hidden door"',
                  "alt='hidden'", "data-hidden=true", 'aria-hidden="false"', 'style="overflow: hidden; display:block"',
                  'style="--x-display:none"', 'title="display:none"', 'data-style="display:none"', "class=hidden",
                  'title="aria-hidden=true"', 'style="display:none;display:block"', 'style="/* display:none */color:red"'):
        assert ex.main_text(f"<body {shown}><p>{text}</p></body>") == text, shown
        assert ex.main_text(f"<article {shown}><p>{text}</p></article>") == text, shown
    for gone in ("hidden", "HIDDEN", 'class="a" hidden', 'hidden=""', "hidden=hidden", 'aria-hidden="true"', "aria-hidden=true",
                 'style="display:none"', "style='color:red; DISPLAY : None !important'", 'title="x"hidden'):
        assert ex.main_text(f"<article><p>{text}</p><div {gone}><p>Not to be seen by anyone.</p></div></article>") == text, gone


def test_articles_inside_wrappers_named_like_furniture():
    text = "Words of a page that are long enough to be read as its text."
    article = f"<article><h2>Title</h2><p>{text}</p></article>"
    for wrapper in ('div class="content with-sidebar"', 'div id="page-form"', 'div class="with-sidebar"', "form id=form1",
                    'div class="page has-banner search"', 'section class="layout side-menu"', "div id=overlay"):
        tag = wrapper.split()[0]
        extra = "<div class=sidebar><p>Links and a long enough sentence that is not the article.</p></div>"
        for inner in (article, article.replace("article", "main"), f"<main>{article}</main>", f"<div class=share>{article}</div>",
                      f"<main><div class=with-ads>{article}</div></main>"):
            assert ex.main_text(f"<body><{wrapper}>{inner}{extra}</{tag}></body>") == f"Title\n\n{text}", (wrapper, inner)
    assert ex.main_text(f'<div class="content with-sidebar"><p>{text}</p></div>') == text


def test_articles_inside_furniture_stay_furniture():
    text = "Words of a page that are long enough to be read as its text."
    other = "<p>Some other words that are no part of the text of this page at all.</p>"
    for more in (f"<aside><article>{other}</article></aside>", f"<footer><div><article>{other}</article></div></footer>",
                 f"<div id=comments><article class=comment>{other}</article></div>",
                 f"<div id=comments><article>{other}</article></div>",
                 f"<div class=related-posts><article class='related-post'>{other}</article></div>"):
        assert ex.main_text(f"<body><div class=with-sidebar><article><p>{text}</p></article>{more}</div></body>") == text, more
    assert ex.main_text(f"<div class=with-sidebar><article><p>{text}</p><div class=sidebar>{other}</div></article></div>") == text


def test_long_page():
    text = " ".join(f"word{i}" for i in range(100_000))
    assert ex.main_text(f"<article><p>{text}</p></article>") == text
    assert ex.main_text("<article>" + "<p>a line</p>" * 5_000 + "</article>").count("a line") == 5_000


def test_cut_is_the_smallest():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 7)
        source, sink = ([rng.randint(0, 9) for _ in range(n)] for _ in range(2))
        edges = [(a, b, rng.randint(0, 6)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(side):
            return sum(source[i] if not s else sink[i] for i, s in enumerate(side)) + sum(
                c for a, b, c in edges if side[a] != side[b])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert cost(ex.min_cut(source, sink, edges)) == best


def test_table(spark):
    got = queries.op10_extraction(spark, "/root/testdata/sf0.01").toPandas().sort_values("page_id")
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").sort_values("page_id")
    for page, text, n in zip(pages["html"], got["text"], got["n_chars"]):
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", article)]
        assert text == "\n\n".join(b for b in blocks if b) and n == len(text)


def test_odd_rows(spark):
    rows = [(1, None, None, "t"), (None, "u", "", "t"), (2, "u", "<p>Words of a page that are long enough.</p>", "t")]
    docs = spark.createDataFrame(rows + rows[2:], "page_id bigint, url string, html string, text string")
    got = ex.extract_pages(docs).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [(1, None, 0), (None, "u", 0), (2, "u", 37), (2, "u", 37)]
    assert ex.extract_pages(docs.limit(0)).count() == 0


THREE = ["The first paragraph of this page tells of a house by the sea and who lived there.",
         "The second one goes on with the story, as second paragraphs are bound to do.",
         "And a third one ends it, so that readers can go and do something else now."]
PROSE = "".join(f"<p>{p}</p>" for p in THREE)


def test_layout_named_like_furniture():
    side = "<div class=sidebar><p>Links and a sentence that is not of the article.</p></div><nav><a href=x>Home</a></nav>"
    for before, after in (('<div class="post hentry category-social">', "</div>"), ('<div class="content menu-open">', "</div>"),
                          ('<div id="main" class="search-page">', "</div>"), ('<form><div id="content">', "</div></form>"),
                          ('<main><div class="related-work">', "</div></main>"), ('<main><div class="two-side">', "</div></main>"),
                          ('<main><section id="discussion">', "</section></main>"), ("<div class=page-form><div>", "</div></div>")):
        for extra in ("", side, "<footer>All rights reserved by the people who wrote this page.</footer>"):
            assert ex.main_text(f"<body>{before}{PROSE}{after}{extra}</body>").split("\n\n") == THREE, (before, extra)


def test_furniture_beside_an_article_stays_furniture():
    talk = "".join(f"<p>Reader {i} says that this is a story of some length and worth it.</p>" for i in range(40))
    for article in (f"<article>{PROSE}</article>", f"<div class=content>{PROSE}</div>", f"<div>{PROSE}</div>", f"<main>{PROSE}</main>"):
        for more in (f"<section id=discussion>{talk}</section>", f"<form>{talk}</form>", f"<div class='user-comments-list'>{talk}</div>"):
            assert ex.main_text(f"<body>{article}{more}</body>").split("\n\n") == THREE, (article[:20], more[:30])


def test_what_readers_wrote_goes_by_its_heading():
    talk = "<p>I think that this is a very interesting story, and long.</p>"
    for heading in ("Comments", "3 comments", "Comments (12)", "Leave a reply", "Kommentare", "Commentaires:", "Comentarios"):
        section = f'<section id="user-opinions"><h3>{heading}</h3>{talk}</section>'
        assert ex.main_text(f"<article>{PROSE}</article>{section}").split("\n\n") == THREE, heading
        assert ex.main_text(f"<article>{PROSE}{section}</article>").split("\n\n") == THREE, heading
        assert ex.main_text(f"<article>{PROSE}<h3>{heading}</h3>{talk}<h3>Sources</h3><p>{THREE[0]}</p></article>").split("\n\n") == [
            *THREE, "Sources", THREE[0]]
    assert "Discussion" in ex.main_text(f"<article>{PROSE}<h2>Discussion</h2><p>{THREE[0]}</p></article>")


def test_formulae_and_fallbacks_of_an_article():
    formula = "<math><mi>E</mi><mo>=</mo><mi>mc</mi><annotation encoding='application/x-tex'>E=mc</annotation></math>"
    page = f"<article>{PROSE}<p>We know that {formula} holds.</p><noscript><p>{THREE[0]}</p></noscript><svg><text>Label</text></svg></article>"
    assert ex.main_text(page).split("\n\n") == [*THREE, "We know that E=mc holds.", THREE[0], "Label"]
    outside = f"<noscript><p>Please enable scripts to see the best of this page.</p></noscript><svg><text>icon</text></svg>"
    assert ex.main_text(f"<body>{outside}<div>{PROSE}</div></body>").split("\n\n") == THREE


def test_broken_marks_take_linear_time():
    import time
    for unit in ("<a ", "<a x='", '<a x="', "<script></script", "</script", "<!", "<a '\"", "<p>x<a x='>", "<i>", "<div>x", "</b><i>", "<!-- ->",
                 "<a x='\"> ", "<div><p>word</div>"):
        page = unit * (2_000_000 // len(unit))
        start = time.perf_counter()
        ex.blocks_of(page)
        assert time.perf_counter() - start < 20, unit
    # marks that nothing closes are text, as before
    assert ex.main_text("<p>text <a x='") == "text <a x='" and ex.main_text("a <b c <!-- d") == "a <b c"
    assert ex.main_text("<p>one</p><!-- > --><p>two") .split("\n\n") == ["one", "two"]
