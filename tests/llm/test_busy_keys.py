"""Keys that hold many rows take another way through a join and give the same rows."""

from collections import Counter

import pytest

from sightline.llm import warc
from sightline.llm._common import join_busy

def rows(df) -> Counter:
    return Counter(tuple(str(x) for x in r) for r in df.collect())


def test_join(spark):
    left = spark.createDataFrame([(i % 3, i) for i in range(30)] + [(7, 99), (7, 100)], "k int, x int")
    right = spark.createDataFrame([(0, "a"), (2, "b"), (5, "c")], "k int, y string")
    want = rows(left.join(right, "k", "left"))
    for busy in ([], [0], [1], [0, 1, 2], [7], [5], [0, 1, 2, 7]):
        got = join_busy(left, right, "k", spark.createDataFrame([(b,) for b in busy], "k int"))
        assert got.columns == ["k", "x", "y"] and rows(got) == want


@pytest.mark.parametrize("busy", [2, 3, 6])
def test_payloads(spark, busy):
    pages = spark.createDataFrame([(i, "u", "x" * 1200 if i % 2 else ("y" * 1100 if i % 3 else f"{i}")) for i in range(12)], "page_id long, url string, html string")
    assert rows(warc.roles(pages, busy=busy)) == rows(warc.roles(pages))
