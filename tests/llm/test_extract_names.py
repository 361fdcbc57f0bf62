"""Furniture words in class names: what is only named after furniture stays."""

import pytest

from sightline.llm.extract import Page

P = "<p>" + "This sentence belongs to the main text of the page. " * 6 + "</p>"
NAV = "<div class='main-nav'><a href='/'>Home</a> <a href='/b'>Other</a></div>"


def text(body: str) -> str:
    page = Page(f"<html><body>{NAV}{body}</body></html>")
    own = page.best()
    return page.at(own[0][0] if own else None)


@pytest.mark.parametrize("wrapper", [
    "div class='content has-sidebar'", "div id=primary class='no-sidebar'", "div class='post with-comments'", "article class='post comments-open'",
    "div class='content-sidebar-wrap'", "div class='layout sidebar-right'", "div class='page-header-fixed nav-on'", "section class='widget'",
])
def test_wrapper_stays(wrapper):
    tag = wrapper.split()[0]
    assert text(f"<{wrapper}><h1>Title</h1>{P}{P}</{tag}>").count("This sentence") == 12


def test_wrapper_of_an_article_stays():
    got = text(f"<div class='search'><article><h1>Title</h1>{P}</article></div><div class='x'>{P}{P}{P}</div>")
    assert "This sentence" in got and "Title" in Page(f"<body><div class='search'><article><h1>Title</h1>{P}</article></div>{P}{P}</body>").at("/body")


def test_title_in_post_header():
    assert text(f"<article><div class='post-header'><h1>Title</h1></div>{P}</article>").startswith("Title")


@pytest.mark.parametrize("noise", ["div class=ad", "div class='sidebar'", "div class='left-sidebar'", "div class='widget widget_text-2'", "div id=comments", "div class='comments-area'", "section class='related-posts'", "div class='site-footer'", "ul class=menu", "div class='newsletter-box'"])
def test_furniture_goes(noise):
    tag = noise.split()[0]
    assert "unwanted" not in text(f"<article><h1>Title</h1>{P}<{noise}><p>unwanted words here</p></{tag}></article>")


@pytest.mark.parametrize("noise", ["div id=comments", "div class='comment-list'", "div class='cookie-notice'"])
def test_long_comments_go(noise):
    assert "unwanted" not in text(f"<article><h1>Title</h1>{P}</article><{noise}><article><p>{'unwanted words of a reader ' * 90}</p></article></div>")
