"""HTML extraction on pages whose article is known."""

import html
import re

import pytest

from glossaflow.llm import html_extraction as H

from . import edges

CHROME = '<nav><ul><li><a href="/a">Home</a><li><a href="/b">News, sport</a></ul></nav><div class="cookie-notice">We use cookies. Really, we do.</div>'
AFTER = '<div id="comments"><p>First comment, quite long, with marks, too.</p></div><aside>About us.</aside><form><p>Name, mail, word.</p><input></form><footer>&copy; us.</footer>'
ARTICLE = ["A headline", "First paragraph, with a link here, and more text that goes on.", "Second one & its text; it is a little longer, so that it is more of it.", "Short."]


def page(body):
    return f"<!doctype html><html><head><title>t</title><style>p{{}}</style><script>var x='</p><p>no, no, no</p>';</script></head><body>{CHROME}{body}{AFTER}</body></html>"


def inner():
    h, a, b, c = ARTICLE
    return f"<h1>{h}</h1><!-- <p>hidden, text</p> --><p>{a.replace('link', '<a href=x>link</a>')}<p>{html.escape(b).replace(' its', chr(10) + chr(9) + ' <b>its</b>')}</p><div class='ad'>Buy, buy, buy. Now.</div><p>{c}<br></p>"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><header>{}</header></main>", "<div class=content><div>{}</div></div>", "<table><tr><td>{}</table>", "<ARTICLE class='post'>{}"])
def test_article_blocks(wrap):
    assert H.main_text(page(wrap.format(inner()))) == "\n\n".join(ARTICLE)


LONG = [f"Paragraph {i}, of the long part, with so many words that most of the text is here; it goes on, and on." for i in range(12)]


def test_all_of_the_article():
    body = "".join(f"<p>{x}</p>" for x in LONG)
    lead, end = "A lead, which says in short what follows, and why.", "The end."
    tail = '<h2>Sources</h2><ol><li><a href="/1">First source</a></li><li><a href="/2">Second source, of two</a></li></ol>'
    want = ["T", lead, *LONG, end, "Sources", "First source", "Second source, of two"]
    for kind in ("div class=body", "section", "blockquote"):
        article = f'<h1><a href="/">T</a></h1><p class=lead>{lead}</p><{kind}>{body}</{kind.split()[0]}><p>{end}</p>{tail}'
        for wrap in ("<article>{}</article>", "<main><article>{}</article></main>", "<div><main>{}</main></div>"):
            assert H.main_text(page(wrap.format(article))) == "\n\n".join(want)
    # an element without a name that says so, and none at all
    held = f"<div class=post><h1>T</h1><p class=lead>{lead}</p>{LONG[0]}<div class=body>{body}</div><p>{lead}</p></div>"
    assert H.main_text(page(held)).split("\n\n") == ["T", lead, LONG[0], *LONG, lead]
    assert H.main_text(page(f'<div><a href="/x">Elsewhere</a></div><h1><a href="/">T</a></h1>{body}')).split("\n\n") == ["T", *LONG]


@pytest.mark.parametrize("said", ['class="overflow-hidden"', 'class="content has-sidebar"', 'class="post no-comments"', 'class="col share-enabled"', 'class="search-result-article"', 'class="widget-free"', 'id="skip-target"', 'class="page"', 'class="widget"', 'class="sidebar main"', "class=notice", "data-x='hidden class=ad'", "title='display:none'"])
def test_names_that_only_hold_a_listed_word(said):
    body = "".join(f"<p>{x}</p>" for x in LONG)
    assert H.main_text(page(f"<div {said}><h1>T</h1>{body}</div>")).split("\n\n") == ["T", *LONG]
    assert H.main_text(page(f"<div {said}><div class='related-posts'><p>Others, too.</p></div><article><h1>T</h1>{body}</article></div>")).split("\n\n") == ["T", *LONG]


@pytest.mark.parametrize("said", ["class=sidebar", "class='site-footer'", "id='cookieBanner'", "class='ad-slot large'", "id=comments", "class='comment-list'", "role=navigation", "hidden", "style='display: none'", "class='newsletter-signup'", "class='share-buttons'"])
def test_names_of_boilerplate(said):
    body = "".join(f"<p>{x}</p>" for x in LONG)
    for held in (f"<div {said}><p>Something else, quite, long.</p></div>", f"<p {said}>Something, else.</p>"):
        assert H.main_text(page(f"<div><h1>T</h1>{body}{held}</div>")).split("\n\n") == ["T", *LONG]


@pytest.mark.parametrize("n", [100, 3000, 5000, 200_000])
def test_attributes_of_any_length(n):
    for value in (f'title="{"a" * n} > leaked, text, here"', f"data-x='{'{' * n}\"<p>leaked, text.</p>\"'", f'a b = "{"<i>x, y</i>" * n}" c=\'>\''):
        assert H.main_text(f"<p {value}>one, two, three.</p>") == "one, two, three."
    assert H.main_text("<p title=it's>one, two.</p><p title=\"never closed>three, four.</p>") == "one, two.\n\nthree, four."


def test_broken_and_empty_pages():
    for text in (None, "", "   ", "<html></html>", "<script>never ends", "<!-- never ends", "<p", "<div class='ad'>Buy.</div>"):
        assert H.main_text(text) == ""
    assert H.main_text("plain text, without any tag.") == "plain text, without any tag."
    assert H.main_text("<p title=\"a>b\">one, two.</p></div></span>") == "one, two."
    assert H.main_text("<p>a &lt; b &#233;&nbsp;c, d.</p>") == "a < b é c, d."
    assert H.main_text("<p>" + "word, " * 50_000 + "</p>").count("word") == 50_000
    assert H.main_text("<div>" * 3000 + "deep, text." + "</div>" * 3000) == "deep, text."


def test_all_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in H.extract(df).collect()}
    for r in df.collect():
        article = re.search(r"<article>(.*?)(</article>|<footer>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n\n".join(x for x in blocks if x) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_rows(spark):
    rows = [(1, None, None, "x"), (1, "u", "<p>a, b.</p>", "y"), (1, "u", "<p>a, b.</p>", "y"), (None, "u", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in H.extract(df).collect()) == [(0, "", 0), (1, "", 0), (1, "a, b.", 5), (1, "a, b.", 5)]
    assert H.extract(df.limit(0)).count() == 0


_PARAGRAPH = "This is a sentence of the article, and it goes on for a while; then it ends here. " * 4
_BODY = [f"{i} {_PARAGRAPH}".strip() for i in range(10)]
_BOX = "Words that stand in a box beside the article, with some marks, and of some length. They are no part of it. " * 2
_NAMED = ["adsbygoogle", "div-gpt-ad-1", "ad-728x90", "fb-comments", "reader-comments", "usercomments", "google-ad", "native-ad", "onetrust-banner-sdk", "cookie-law-info-bar", "legal-notice", "paywall-notice", "userComments"]


def _page(before="", inside="", after="", tag="article"):
    paragraphs = "".join(f"<p>{x}</p>" for x in _BODY)
    return f"<html><body>{before}<{tag}>{paragraphs}{inside}</{tag}>{after}</body></html>"


@pytest.mark.parametrize("name", [*_NAMED, "site-header", "page-header", "discussion", "zorp-quux", ""])
def test_a_box_beside_an_article(name):
    """Whatever its name is, and though its text reads like an article's."""
    box = f'<div class="{name}"><p>{_BOX}</p></div>'
    want = "\n\n".join(_BODY)
    assert H.main_text(_page(before=box)) == want
    assert H.main_text(_page(after=box)) == want
    assert H.main_text(_page(before=box, tag="main")) == want


@pytest.mark.parametrize("name", _NAMED)
def test_a_named_box_inside_an_article(name):
    for box in (f'<div class="{name}"><p>{_BOX}</p></div>', f'<section id="{name}">{_BOX}</section>'):
        assert H.main_text(_page(inside=box)) == "\n\n".join(_BODY)


@pytest.mark.parametrize("name", ["no-comments", "has-ads", "with-sidebar", "post-body", "share-price-table", "search-theory"])
def test_a_name_that_says_something_else(name):
    assert H.main_text(_page(inside=f'<div class="{name}"><p>{_BOX}</p></div>')) == "\n\n".join([*_BODY, _BOX.strip()])


@pytest.mark.parametrize("name", ["comments", "replies", "discussion-comments", "ads"])
def test_an_article_in_an_element_with_a_wrong_name(name):
    paragraphs = "".join(f"<p>{x}</p>" for x in _BODY)
    assert H.main_text(f'<html><body><div id="{name}">{paragraphs}</div></body></html>') == "\n\n".join(_BODY)


def test_comments_that_are_longer_than_the_article():
    comments = "".join(f'<div class="comment"><b>name {i}</b><p>{_PARAGRAPH}</p></div>' for i in range(30))
    assert H.main_text(_page(after=f'<div id="comments">{comments}</div>')) == "\n\n".join(_BODY)


def ratios(blocks):
    """Fused ratios by plain loops: of each path the means, smoothed with the two blocks to either side."""
    import math

    own = [len(b.text) - b.linked for b in blocks]
    marks = [sum(c in ".,;:!?…。，、；：！？" for c in b.text) for b in blocks]
    mean = lambda values, path: sum(v for v, b in zip(values, blocks, strict=True) if b.path == path) / sum(b.path == path for b in blocks)
    length, punctuation = ([mean(v, b.path) for b in blocks] for v in (own, marks))
    weights = {d: math.exp(-d * d / 2) for d in range(-2, 3)}
    whole = sum(weights.values())
    at = lambda v, i: v[min(max(i, 0), len(v) - 1)]
    smooth = lambda v, i: sum(w * at(v, i + d) for d, w in weights.items()) / whole
    return [math.sqrt(max(length[i], 0) * smooth(length, i)) * (1 + math.sqrt(punctuation[i] * smooth(punctuation, i))) for i in range(len(blocks))]


def test_scores_equal_plain_loops(spark):
    pages = [r.html for r in spark.read.parquet(f"{edges.SF}/pages.parquet").collect()] + [_page(), _page(before="<ul><li>a<li>b</ul>")]
    for page in pages:
        blocks = H.read(page)
        if blocks:
            assert H.path_scores(blocks) == pytest.approx(ratios(blocks))
