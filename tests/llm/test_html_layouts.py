"""Class names that only mention a page part, marked parts, and deep nesting."""

import time

import pytest

from petrigrid.llm.html_extraction import Page

TEXT = " ".join(["The text of the article goes on for a while and holds a number of sentences."] * 6)


def main_text(source):
    page = Page(source)
    at = page.main()
    return "" if at is None else page.under(page.named(at))


@pytest.mark.parametrize(
    "source",
    [
        "<div class='content no-sidebar'><p>{}</p></div>",
        "<main class='with-nav'><p>{}</p></main>",
        "<div id='legal-analysis'><p>{}</p></div>",
        "<div class='header-image post'><p>{}</p></div>",
        "<div class='social-science'><article><p>{}</p></article></div>",
        "<div class='sidebar'><main><p>{}</p></main></div>",
        "<div class='w-1/2'><article class='post'><p>{}</p></article></div>",
    ],
)
def test_layouts_that_only_name_a_part(source):
    assert main_text(source.format(TEXT)) == TEXT


def test_parts_still_go():
    page = f"<div class='site-header'>Site name and motto</div><div class='post'><h1>Title</h1><p>{TEXT}</p><p>{TEXT}</p></div>"
    page += f"<div class='sidebar'><p>Side text</p></div><div id='comments'><div class='comment'><p>{TEXT} first</p></div><p>{TEXT} second</p></div><div class='cookie-banner'>We use cookies</div>"
    assert main_text(page) == f"Title\n{TEXT}\n{TEXT}"


def test_title_in_a_header_of_the_article():
    assert main_text(f"<article><div class='post-header'><h1>Title</h1></div><p>{TEXT}</p><div class='share'>Share this</div></article>") == f"Title\n{TEXT}"


def test_deep_nesting_is_linear():
    def seconds(n):
        t = time.perf_counter()
        assert main_text("<div class='a b'>" * n + "text" + "</div>" * n) == "text"
        return time.perf_counter() - t

    seconds(1000)
    assert seconds(40_000) < 12 * max(seconds(10_000), 0.02)
