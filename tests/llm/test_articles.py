"""Titles, leads and closing parts beside the longest part of an article."""

import pytest

from kerbline.llm import html_text

PROSE = "Long prose stands here, with commas, and more words than any other part of the page has. "


@pytest.mark.parametrize("tag", ["article", "main"])
@pytest.mark.parametrize("n", [1, 5, 50])
def test_an_article_is_kept_whole(tag, n):
    body = f"<p>{PROSE}</p>" * n
    html = f"<nav><a>menu</a></nav><{tag}><h1>Title</h1><p class=lead>The lead.</p><div class='content'>{body}</div><div class=share>no</div><div class='more'><p>The end.</p></div></{tag}><div><p>{PROSE}</p></div>"
    assert html_text.main_text(html) == f"Title The lead. {PROSE * n}The end."


def test_the_innermost_article_counts():
    html = f"<main><p>Around.</p><article><h1>Title</h1><div class='content'>{f'<p>{PROSE}</p>' * 9}</div></article></main>"
    assert html_text.main_text(html) == f"Title {PROSE * 9}".strip()
