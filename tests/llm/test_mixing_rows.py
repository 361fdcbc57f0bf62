"""Mixing: equal rows, ids of other types, and the choice against a plain version."""

import itertools
from collections import Counter

import pytest

from sightline.llm import mixing


def mixed(spark, rows, schema="doc_id long, text string, source string", **options):
    return mixing.mix(spark.createDataFrame(rows, schema).repartition(3), **options).collect()


def w(n: int) -> str:
    return " ".join(["w"] * n)


@pytest.mark.parametrize("ids", [lambda i: 7, lambda i: None, lambda i: i])
def test_equal_rows(spark, ids):
    """All rows alike: one and a half copies on average, whatever the ids."""
    out = mixed(spark, [(ids(i), w(10), "a") for i in range(1000)])
    assert Counter(r.copies for r in out) == {1: 500, 2: 500} and {r.target for r in out} == {15000.0}


def test_equal_rows_beside_others(spark):
    rows = [(5, w(30), "a")] * 400 + [(i, w(1 + i % 50), "a") for i in range(1000, 1400)] + [(i, w(9), "b") for i in range(2000, 2900)] + [(6, w(17), "b")] * 100
    out = mixed(spark, rows)
    for s in "ab":
        own = [r for r in out if r.src == [s]]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.01 * own[0].target
    assert Counter((r.doc_id, r.copies) for r in out) == Counter((r.doc_id, r.copies) for r in mixed(spark, rows[::-1]))


def test_string_ids(spark):
    rows = [(None if i % 50 == 0 else f"d{i}", w(1 + i % 9), "ab"[i % 2]) for i in range(600)]
    out = mixed(spark, rows, "doc_id string, text string, source string")
    assert len(out) == 600 and out[0].__fields__[0] == "doc_id" and {r.doc_id for r in out} == {r[0] for r in rows}
    for s in "ab":
        own = [r for r in out if r.src == [s]]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.01 * own[0].target


def test_too_many_patterns(spark):
    with pytest.raises(ValueError):
        mixed(spark, [(i, "x", f"s{i}") for i in range(9)], max_patterns=8)


def cost(capacity, members, quota, repeats):
    """Largest flow, and its least cost, by trying all ways."""
    best = None
    choices = [[x for x in itertools.product(range(repeats * c + 1), repeat=len(m)) if sum(x) <= repeats * c] for c, m in zip(capacity, members, strict=True)]
    for way in itertools.product(*choices):
        into = Counter()
        for m, x in zip(members, way, strict=True):
            for s, n in zip(m, x, strict=True):
                into[s] += n
        if all(into[s] <= q for s, q in enumerate(quota)):
            price = sum(sum(k // c for k in range(sum(x))) if c else 0 for c, x in zip(capacity, way, strict=True))
            key = (-sum(into.values()), price)
            best = key if best is None or key < best else best
    return best


@pytest.mark.parametrize("capacity, members, quota, repeats", [
    ([2, 3], [(0,), (0, 1)], [4, 3], 2), ([2, 2, 1], [(0,), (0, 1), (1,)], [5, 2], 2), ([1, 3], [(0, 1), (1,)], [2, 6], 2), ([2], [(0, 1)], [3, 3], 3), ([0, 2], [(0,), (0, 1)], [1, 5], 2), ([3, 1, 1], [(0, 1, 2), (2,), (1,)], [1, 2, 3], 2),
])
def test_flow_is_cheapest(capacity, members, quota, repeats):
    got = mixing.flow(capacity, members, quota, repeats)
    used, into = Counter(), Counter()
    for (p, s), n in got.items():
        assert s in members[p]
        used[p] += n
        into[s] += n
    assert all(used[p] <= repeats * c for p, c in enumerate(capacity)) and all(into[s] <= q for s, q in enumerate(quota))
    price = sum(sum(k // c for k in range(used[p])) if c else 0 for p, c in enumerate(capacity))
    assert (-sum(into.values()), price) == cost(capacity, members, quota, repeats)


def test_choice_by_hand(spark):
    """The words of each source end within half of the document next in order, and all copies are those of the seeded order."""
    rows = [(i, w(1 + i * 7 % 40), "abc"[i % 3]) for i in range(300)]
    out = mixed(spark, rows)
    for s in "abc":
        own = [r for r in out if r.src == [s]]
        size = sum(r["size"] for r in own)
        whole, rest = divmod(round(own[0].target), size) if size else (0, 0)
        assert all(r.copies in (whole, min(whole + 1, 2)) for r in own)
        gap = own[0].target - sum(r.taken for r in own)
        # No single document gained or given back would bring the source nearer.
        assert all(abs(gap) <= abs(gap - r["size"]) + 0.5 for r in own if r.copies < min(whole + 1, 2)) and all(abs(gap) <= abs(gap + r["size"]) + 0.5 for r in own if r.copies > whole)
