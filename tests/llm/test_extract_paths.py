"""Main text around and beside the path that scores best."""

import pytest

from sightline.llm.extract import Page, extract

P = "<p>" + "This sentence belongs to the main text of the page. " * 8 + "</p>"
INTRO = "<p>An introduction that is short beside what follows it.</p>"
NAV = "<div class='x'><a href='/'>Home</a> <a href='/b'>Other</a></div>"
FOOT = "<div class='y'><p>Imprint and terms of this site.</p></div>"


def page(body: str) -> str:
    return f"<html><body><div id=page>{NAV}{body}{FOOT}</div></body></html>"


def texts(spark, pages: list[str]) -> list[str]:
    df = spark.createDataFrame([(i, "http://h.example/" + str(i), h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(extract(df).collect())]


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<main>", "</main>"), ("<div class=content>", "</div>")])
@pytest.mark.parametrize("inner", [f"<section>{P}{P}</section>" * 3, f"<section class=a>{P * 4}</section><section class=b>{P}</section>", f"<blockquote>{P * 6}</blockquote>", f"<table><tr><td>{P * 6}</td><td>{P}</td></tr></table>"])
def test_nested(spark, open_, close, inner):
    for got in texts(spark, [page(f"{open_}<h1>Title</h1>{INTRO}{inner}{close}")] * 2):
        assert got.startswith("Title\n\nAn introduction") and got.count("This sentence") == inner.count("This sentence")
        assert "Home" not in got and "Imprint" not in got


def test_mixed_templates(spark):
    usual = page(f"<div class=text><h1>Title</h1>{P}</div>")
    other = page(f"<div class=text><p>A small box.</p></div><div class=story><h1>Long</h1>{P * 4}</div>")
    got = texts(spark, [usual] * 5 + [other])
    assert all(x.startswith("Title") for x in got[:5]) and got[5].startswith("Long") and got[5].count("This sentence") == 32


def test_boxes_beside_stay_out():
    got = Page(page(f"<div class=content>{P * 4}</div><div class=col2>{P}</div>")).main(None)
    assert got.count("This sentence") == 32


def test_layout_table():
    got = Page(page(f"<table><tr><td class=left>{P}</td><td class=mid>{P * 4}</td></tr></table>")).main(None)
    assert got.count("This sentence") == 32
