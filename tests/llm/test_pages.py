"""Reader comments out, linked and named text in, and pages that never close a tag."""

import time

import pytest

from kerbline.llm import html_text

PROSE = "Long prose stands here, with commas, and more words than any other part of the page has."
BODY = f"<p>{PROSE}</p>" * 3
TEXT = " ".join([PROSE] * 3)
COMMENT = "<p>First! I, for one, do not agree with any of this, and I have a lot more to say about it, too.</p>"


@pytest.mark.parametrize("name", ["post-comments", "entry-comments", "comment-body", "article-comments", "postComments", "post-footer", "post-share", "content-ad", "story-related", "main-sidebar", "comments-wrapper"])
@pytest.mark.parametrize("attribute", ["class", "id"])
def test_named_parts_go_whatever_else_their_names_say(name, attribute):
    assert html_text.main_text(f"<main><article><h1>Title</h1>{BODY}<div {attribute}='{name}'>{COMMENT * 4}</div></article></main>") == f"Title {TEXT}"


def test_an_article_that_is_a_comment_goes():
    html = f"<main><article class='post comments-open has-sidebar'><h1>Title</h1>{BODY}</article><article class='comment even depth-1'>{COMMENT}</article><article class='comment odd'>{COMMENT}</article></main>"
    assert html_text.main_text(html) == f"Title {TEXT}"


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("<h1><a href=1>Linked title</a></h1>{}", "Linked title {}"), ("{}<h2>Sources</h2><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>", "{} Sources One Two"),
        ("<p class='lead social'>The lead.</p>{}", "The lead. {}"), ("{}<details>Short note.</details>", "{} Short note."), ("{}<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>", "{} So x=2 holds."),
        ("<div class='entry-header'><h1>Title</h1></div>{}", "Title {}"), ("<header><h1>Title</h1></header>{}", "Title {}"), ("<p class='ad'>Buy.</p>{}", "{}"), ("<div class='content-sidebar-wrap'>{}</div>", "{}"), ("<div class='research-notes'>{}</div>", "{}"),
    ],
)
def test_text_of_an_article_stays(inner, text):
    assert html_text.main_text(f"<nav><a>menu</a></nav><article>{inner.format(BODY)}</article><footer>f</footer>") == text.format(TEXT)


def test_headings_stay_and_link_lists_go_where_no_article_is():
    html = f"<div id=x><h2><a href=1>Linked title</a></h2>{BODY}<ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul></div>"
    assert html_text.main_text(html) == f"Linked title {TEXT}"


@pytest.mark.parametrize("part", ["<a ", "<a", "<!", "<!-", "</", "</a", "<a '", '<a b="', "<span hidden>", "<script", "<script ", "< ", "<a b='>", "<p><a ", "&amp", "<i hidden>x", "<div><p>x"])
def test_reading_is_linear(part):
    start = time.perf_counter()
    html_text.main_text(f"<p>{PROSE}</p>" + part * 200_000)
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize(("html", "text"), [("<p>a<b", "a<b"), ("<p>a<b <!-- c", "a<b"), ("<p>a <b c='d' e", "a <b c='d' e"), ("a<!b", "a<!b"), ("<p>x</p><", "x <"), ("<p>x</p><p y='>z", "x z"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2")])
def test_unfinished_tags_are_text(html, text):
    assert html_text.main_text(html) == text
