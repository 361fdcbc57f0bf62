"""Toxicity by brute force; archives of payloads that compress very well, and of changed payloads."""

import gzip
import hashlib
import math
import subprocess
import sys

import numpy as np
import pytest

from sightline.llm import toxicity, warc


def test_segments_with_all_signs():
    rng = np.random.default_rng(4)
    for _ in range(200):
        s = np.where(rng.random(25) < 0.5, rng.normal(0.2, 2, 25), -0.4)
        got = toxicity.segments([(i, float(x)) for i, x in enumerate(s) if x != -0.4], 0.4)
        best = max(s[i : j + 1].sum() for i in range(25) for j in range(i, 25))
        assert (max(x for _, _, x in got) if got else 0.0) == pytest.approx(max(best, 0.0))
        for a, b, x in got:
            assert x == pytest.approx(s[a : b + 1].sum()) and all(s[a : k + 1].sum() > 0 for k in range(a, b + 1)) and all(s[k : b + 1].sum() > 0 for k in range(a, b + 1))


def test_score_by_hand():
    """A text's score from its words' weights, segment by segment."""
    m = toxicity.Model({"bad": 3.0, "vile*": 2.0, "kind": -1.5}, 0.5)
    m.lam, m.k, m.a, m.b = 0.9, 0.2, -3.0, 1.2
    words = "a bad vilest kind day and a bad bad bad kindly end b c d e f g h bad".split()
    s = [(3.0 if w == "bad" else 2.0 if w.startswith("vile") else -1.5 if w == "kind" else 0.0) - 0.5 for w in words]
    # Segments: 'bad vilest', 'bad bad bad' and the last 'bad' (the words between cost more than they bring).
    sums = [sum(s[1:3]), sum(s[7:10]), s[-1]]
    found = m.passages(" ".join(words))[1]
    assert [x for _, _, x in found] == pytest.approx(sums) or [x for _, _, x in found] == pytest.approx([sum(s[1:10]), s[-1]])
    some = sorted((max(0.0, 0.9 * x - math.log(0.2 * len(words))) for _, _, x in found), reverse=True)
    evidence = math.log1p(sum(x / (i + 1) for i, x in enumerate(some) if i == 0 or x > 3))
    assert m.probability(" ".join(words)) == pytest.approx(1 / (1 + math.exp(3.0 - 1.2 * evidence)))


def test_lambda_solves_for_words():
    """Words of +2 with chance 0.1, else -0.5: sum of chances times exp(lambda * score) is 1."""
    lam = toxicity.root(np.array([2.0, -0.5]), np.array([0.1, 0.9]))
    assert 0.1 * math.exp(2 * lam) + 0.9 * math.exp(-0.5 * lam) == pytest.approx(1) and lam > 0.1


def test_weights(spark):
    rows = [("toxic", 50, 10), ("clean", 2, 400), ("plain", 11, 89), ("rare", 2, 0), ("kind", 0, 300)]
    got = {r.f: r.x for r in toxicity.weigh(spark.createDataFrame(rows, "f string, a long, c long"), 110, 890).collect()}
    assert got.keys() == {"toxic", "clean", "kind"} and got["toxic"] > 0 > got["clean"]
    p = 10 * 60 / 1000
    assert got["toxic"] == pytest.approx(math.log((50 + p) / (120 - 50 - p)) - math.log((10 + p) / (900 - 10 - p)))


READ = """
import resource, sys
sys.path.insert(0, {root!r})
from sightline.llm.warc import chunks_of
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
with open({path!r}, "rb") as f:
    n = sum(len(r[6]) for r in chunks_of(f))
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base)
"""


def test_memory_is_flat(tmp_path):
    """A record of 256 MB that packs to a quarter of a megabyte."""
    size, block = 1 << 28, b"x" * (1 << 20)
    sha = hashlib.sha1()
    with gzip.open(tmp_path / "big.gz", "wb", 1) as out:
        for _ in range(size >> 20):
            sha.update(block)
        out.write(f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {size}\r\nWARC-Payload-Digest: sha1:{sha.hexdigest()}\r\n\r\n".encode())
        for _ in range(size >> 20):
            out.write(block)
        out.write(b"\r\n\r\n")
    root = str(__import__("pathlib").Path(warc.__file__).parents[2])
    done = subprocess.run([sys.executable, "-c", READ.format(root=root, path=str(tmp_path / "big.gz"))], capture_output=True, text=True, check=True)
    n, grown = map(int, done.stdout.split())
    assert n == size and grown < 20_000


def test_changed_payload(tmp_path):
    for payload, fails in ((b"same", False), (b"sane", True)):
        head = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\nWARC-Payload-Digest: sha1:{hashlib.sha1(b'same').hexdigest()}\r\n\r\n".encode()
        (tmp_path / "a.warc").write_bytes(head + payload + b"\r\n\r\n")
        with open(tmp_path / "a.warc", "rb") as f:
            if fails:
                with pytest.raises(ValueError):
                    list(warc.chunks_of(f))
            else:
                assert len(list(warc.chunks_of(f))) == 1
