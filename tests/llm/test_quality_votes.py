"""The quality verdict against expectation-maximisation row by row, and its prior."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from sightline.llm import quality

SF = "/root/testdata/sf0.001"


def votes_of(x: str | None) -> list[int]:
    x = x or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    lines = [s for s in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = len({j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})
    n, chars, n_lines = max(len(w), 1), max(sum(map(len, w)), 1), max(len(lines), 1)
    symbols, digits = sum(c in quality.SYMBOLS for c in x), sum("0" <= c <= "9" for c in x)
    copies, mean = len(lines) - len(set(lines)), sum(map(len, w)) / n
    bad = lambda x, good=False: -1 if x else int(good)
    return [
        bad(len(w) < 10), bad(mean < 2 or mean > 15), bad(symbols / n > 0.1, symbols / n < 0.01 and len(w) >= 10), bad(symbols / chars > 0.05),
        bad(copies >= 3 and copies / n_lines > 0.3), bad(repeated / n > 0.2, repeated == 0 and len(w) >= 10),
        bad(len(w) >= 10 and len(set(w)) / n < (0.5 if len(w) < 100 else 0.15)), bad(digits / chars > 0.2),
    ]


def by_rows(rows: list[list[int]], rounds: int = 50) -> list[float]:
    """The probability that each row is good: the same model, one row at a time."""
    start = [{-1: 0.4, 0: 0.45, 1: 0.15}, {-1: 0.02, 0: 0.58, 1: 0.4}]
    rate, good = [[dict(start[c]) for _ in rows[0]] for c in (0, 1)], 0.8

    def posterior(v):
        a, b = ((1 - good) * math.prod(r[x] for r, x in zip(rate[0], v, strict=True)), good * math.prod(r[x] for r, x in zip(rate[1], v, strict=True)))
        return b / (a + b)

    for _ in range(rounds):
        p = [posterior(v) for v in rows]
        for c in (0, 1):
            for k, r in enumerate(rate[c]):
                n = {x: quality.PRIOR_DOCS * start[c][x] + sum(q if c else 1 - q for q, v in zip(p, rows, strict=True) if v[k] == x) for x in (-1, 0, 1)}
                r.update({x: n[x] / sum(n.values()) for x in n})
        good = min(max(sum(p) / len(p), 0.01), 0.99)
    return [posterior(v) for v in rows]


def test_verdicts(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").select(["doc_id", "text"]).to_pylist()
    votes = [votes_of(d["text"]) for d in docs]
    want = dict(zip((d["doc_id"] for d in docs), by_rows(votes), strict=True))
    rows = {r.doc_id: r for r in quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert len(rows) == len(docs)
    for d, v in zip(docs, votes, strict=True):
        r = rows[d["doc_id"]]
        assert r.votes == v and r.quality == pytest.approx(want[d["doc_id"]], abs=1e-6)
        assert r.kept == (not r.base_failed and want[d["doc_id"]] >= 0.5)


def test_prior_fades():
    rng = np.random.default_rng(2)
    good = rng.random(5000) < 0.7
    votes = np.where(rng.random((5000, 5)) < np.where(good, 0.05, 0.6)[:, None], -1, 1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    free = quality.estimate(patterns, n * 1e4, strength=1e-9)["rate"]
    off = [np.abs(quality.estimate(patterns, n * float(k))["rate"] - free).max() for k in (1, 10, 1000)]
    assert off[0] > off[1] > off[2] and off[2] < 1e-4
