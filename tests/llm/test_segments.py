"""Maximal scoring segments in linear time."""

import time

import numpy as np

from sightline.llm import toxicity


def plainly(s: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring segments by their definition: the best one, of equal ones the shortest, then those of what lies on either side."""
    sums = [((sum(s[i : j + 1])), i - j, -i, j) for i in range(len(s)) for j in range(i, len(s))]
    if not sums or (top := max(sums))[0] <= 0:
        return []
    _, _, i, j = top
    i = -i
    return plainly(s[:i]) + [(i, j)] + [(a + j + 1, b + j + 1) for a, b in plainly(s[j + 1 :])]


def test_by_definition():
    rng = np.random.default_rng(7)
    for _ in range(400):
        s = rng.normal(-0.2, 1.0, rng.integers(1, 25))  # no two sums are equal
        got = toxicity.segments([(i, float(x)) for i, x in enumerate(s)], 0.4)
        assert [(a, b) for a, b, _ in got] == plainly(s.tolist())
        assert all(abs(x - s[a : b + 1].sum()) < 1e-9 for a, b, x in got)


def test_linear():
    began = time.time()
    apart = toxicity.segments([(6 * i, 1.0) for i in range(300_000)], 0.4)  # each segment starts below all before it
    joined = toxicity.segments([(2 * i, 1.0) for i in range(300_000)], 0.4)
    falling = toxicity.segments([(i, 1.0 if i % 2 else -0.9 - i / 1e6) for i in range(300_000)], 0.4)
    assert len(apart) == 300_000 and len(joined) == 1 and len(falling) >= 1
    assert time.time() - began < 20
