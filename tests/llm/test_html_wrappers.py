"""op10: wrappers that must not empty a page, and what stands around it."""

from __future__ import annotations

import pytest

from rowloom.llm import html

TEXT = "Some text of the article."
OPEN = [
    '<div style="overflow:hidden">', '<div style="visibility: visible; overflow: hidden">', '<div aria-hidden="false">', "<div aria-hidden=false>",
    '<div class="content-sidebar-wrap">', '<section class="no-sidebar">', '<div class="has-sidebar">', '<div class="with-sidebar grid">',
    '<div class="main-nav-container">', '<div id="page-footer-wrapper">', '<div class="is-hidden-mobile">', '<div data-hidden="x">',
    '<div title="hidden">', '<div class="without-comments">', '<div class="sidebar">', '<div class="widget">', '<div class="site-header">',
    '<div class="show_sidebar">', '<section role="complementary">', '<div class="no-js hide-sidebar">', '<div class="adsorb">', '<td class="navy">',
]
SHUT = [
    "<div hidden>", '<div hidden="until-found">', "<div class=x hidden >", '<div aria-hidden="true">', "<div aria-hidden=true>",
    '<div style="display:none">', "<div style='color:red; display : none'>", "<nav>", "<footer>", "<aside>", '<form class="x">',
]


@pytest.mark.parametrize("wrapper", OPEN)
def test_an_article_is_found_in_it(wrapper):
    tag = wrapper[1:].split()[0].rstrip(">")
    assert html.main_text(f"<body><p>Menu</p>{wrapper}<article><h1>Title</h1><p>{TEXT}</p></article></{tag}></body>") == f"Title\n\n{TEXT}"


@pytest.mark.parametrize("wrapper", SHUT)
def test_what_is_hidden_or_around_stays_out(wrapper):
    tag = wrapper[1:].split()[0].rstrip(">")
    page = f"<body>{wrapper}<article><p>Not this.</p></article></{tag}><article><p>{TEXT}</p></article></body>"
    assert html.main_text(page) == TEXT


def test_articles_that_are_no_main_text():
    for inner in ('<div class="comments"><article class="comment"><p>Nice one.</p></article></div>', '<div class="related"><article><p>Read on.</p></article></div>'):
        assert html.main_text(f"<body><article><p>{TEXT}</p></article>{inner}</body>") == TEXT


def test_a_teaser_is_not_the_page():
    long = "The text of this page is in a plain division, and it is as long as you want it to be. " * 5
    got = html.main_text(f"<body><div><p>{long}</p></div><article><p>Read more of the others</p></article></body>")
    assert long.strip() in got


def test_links_inside_an_article_stay():
    assert html.main_text(f'<body><article><p><a href="x">all of it is a link</a></p><p>{TEXT}</p></article></body>') == f"all of it is a link\n\n{TEXT}"
