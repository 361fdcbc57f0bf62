"""Main text: bad html in linear work, sections with names of furniture, and the host vote against a plain version."""

import resource
import time
from collections import defaultdict
from fractions import Fraction

import pytest

from sightline.llm.extract import Page, extract, host, votes, winners
from pyspark.sql import functions as F

P = "<p>" + "This sentence belongs to the main text of the page. " * 6 + "</p>"
N = 100_000
HARD = {
    "unmatched": "<b>" * N + P + "</i>" * N,
    "nested": "<div>" * N + P + "</div>" * N,
    "nested text": "<div>some words" * N,
    "suspects": "<div class=sidebar>words" * N + P,
    "kept open": "<b>" + "<div>" * N + "</b>" * N + P,
    "paragraphs": "<b>" * N + "<p>words" * N,
    "inline": "<b><i>" * N + "</b>" * N + P,
    "no end": "<a " * N,
    "quotes": "<a \">\" " * N + "'" + P,
    "raw": P + "<svg>" * N + "<select>" * N,
    "tables": "<table><tr><td>" * N + P,
}


@pytest.mark.parametrize("name", HARD)
def test_linear(name):
    began, before = time.process_time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    page = Page(f"<html><body>{HARD[name]}</body></html>")
    page.ranked()
    page.main(None)
    assert time.process_time() - began < 30 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


def text(body: str) -> str:
    return Page(f"<html><body><nav><a href=/>Home</a></nav>{body}<footer>Imprint</footer></body></html>").main(None)


@pytest.mark.parametrize("name", ["search", "related-work", "social", "share"])
def test_named_sections_stay(name):
    got = text(f"<article><h1>T</h1>{P}<section class='{name}'><h2>S</h2>{P}</section>{P}</article>")
    assert got.count("This sentence") == 18 and "S" in got.split("\n\n")


@pytest.mark.parametrize("box", [
    "<div class=related><ul><li><a href=/a>Another story of ours</a></li><li><a href=/b>And one more of them</a></li></ul></div>", "<div class=sidebar>" + P.replace("belongs", "strays") + "</div>",
    "<div class=comments>" + P.replace("belongs", "strays") + "</div>", "<div class=share><a href=/x>Share this</a></div>", "<aside>" + P.replace("belongs", "strays") + "</aside>",
])
def test_boxes_go(box):
    got = text(f"<article><h1>T</h1>{P}{box}{P}</article>")
    assert got.count("This sentence belongs") == 12 and "strays" not in got and "story" not in got and "Share" not in got


def test_header_keeps_its_lead():
    lead = "A first paragraph that stands in the header of the article and says in a sentence what follows."
    got = text(f"<article><header><h1>T</h1><p>By someone</p><p>{lead}</p><div>x</div></header>{P}</article>")
    assert got.split("\n\n")[:2] == ["T", lead] and "By someone" not in got


@pytest.mark.parametrize("tag", ["svg", "select", "object", "noscript", "template", "math"])
def test_unclosed_elements_end_with_their_block(tag):
    assert text(f"<article><div><{tag}>gone</div>{P}</article>").count("This sentence") == 6
    assert "gone" not in text(f"<article><div><{tag}>gone</div>{P}</article>")


def test_comments_and_rests():
    assert text(f"{P}<!-- a > b").count("This sentence") == 6
    assert Page("<p>one <!-- two").main(None) == "one" and Page("<p>one < two").main(None) == "one < two" and Page("a > b").main(None) == "a > b"


def test_host_vote(spark):
    """Winners by hand from each page's own paths: 1, 1/2, 1/3 by rank, then the sum of scores, then the path."""
    make = lambda k, c: f"<div class='{c}{k}'><h1>T</h1>{P * (1 + k % 3)}</div><table><tr><td class=x>{P * (k % 4)}</td></tr></table>"
    rows = [(k, f"http://h{k % 3}.example/{k}" if k % 7 else None, make(k, "ab"[k % 5 == 0])) for k in range(60)] + [(99, "x", None), (98, "http://h0.example/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    hosts = {r.url: r.h for r in df.select("url", host(F.col("url")).alias("h")).collect()}
    sums: dict = defaultdict(lambda: [Fraction(0), 0.0])
    for _, url, html in rows:
        for k, (path, score) in enumerate(Page(html).ranked(3)):
            sums[hosts[url], path][0] += Fraction(1, k + 1)
            sums[hosts[url], path][1] += score
    best = {}
    for (h, path), (v, s) in sums.items():
        best[h] = min(best.get(h, (9, 0, "")), (-round(float(v), 6), -round(s, 3), path))
    assert {r.host: r.path for r in winners(df).collect()} == {h: x[2] for h, x in best.items()}
    got = {(r.host, r.path): r.votes for r in votes(df).collect()}
    assert got == {k: round(float(v), 6) for k, (v, _) in sums.items()}
    texts = {r.page_id: r.text for r in extract(df).collect()}
    assert texts == {i: Page(t).main(best[hosts[u]][2] if hosts[u] in best else None) for i, u, t in rows}
