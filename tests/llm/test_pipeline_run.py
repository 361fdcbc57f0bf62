"""run() against plain Python forms of its five stages, every document judged at every stage. Of toxicity the fitted model is given; its passages, law and
curve are worked out here."""

import math
import re
from collections import Counter

import pyarrow.parquet as pq
import xxhash

import corpus_pipeline as cp
from sightline.llm import toxicity
from sightline.llm._common import table

SF = "/root/testdata/sf0.01"


def passages(s):
    """Scores of the maximal segments, by definition."""
    out, open_ = [], [s]
    while open_:
        s = open_.pop()
        low, best, total, at = 0.0, (0.0, 0, 0), 0.0, 0
        for i, x in enumerate(s):
            total += x
            if total - low > best[0] + 1e-12:
                best = (total - low, at, i + 1)
            if total < low:
                low, at = total, i + 1
        if best[0] > 0:
            out.append(best[0])
            open_ += [s[: best[1]], s[best[2] :]]
    return out


def toxic(model, text):
    def weight(w):
        return next((x for f in (w, *(w[:k] + "*" for k in (6, 5, 4) if len(w) > k)) if (x := model.weights.get(f)) is not None), 0.0)

    s = [weight(w) - model.penalty for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
    chance = sorted((max(0.0, model.lam * x - math.log(max(model.k * len(s), 1e-9))) for x in passages(s)), reverse=True)
    evidence = math.log1p(sum(x / (i + 1) for i, x in enumerate(chance) if i == 0 or x > 3))
    return 1 / (1 + math.exp(-(model.a + model.b * evidence)))


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def first_of_groups(docs):
    prints, root = {i: fingerprint(t) for i, (t, _) in docs.items()}, {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in docs:
        for j in docs:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: d for i, d in docs.items() if find(i) == i}


def words8(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def contaminated(text, windows):
    w, hit = words8(text), set()
    for n, some in windows.items():
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in some:
                hit.update(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def redacted(text):
    if text is None:
        return None
    found = [m.span() for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[1]) >= 12]
    for rule in ("AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}", r"(?<![A-Za-z0-9_])xox[abeoprs]-[A-Za-z0-9-]{10,}",
                 r"(?<![A-Za-z0-9_])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/:@]{3,}@"):
        found += [m.span() for m in re.finditer(rule, text, re.A)]
    runs = []
    for a, b in sorted(found):
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    for a, b in reversed(runs):
        text = text[:a] + "[SECRET]" + text[b:]
    return text


def test_run(spark):
    docs = {r["doc_id"]: (r["text"], r["source"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    left = {i: d for i, d in docs.items() if toxic(model, d[0]) < 0.3}
    assert len(left) < len(docs)
    left = first_of_groups(left)
    windows = {}
    for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist():
        w = words8(r["text"])
        n = min(13, len(w))
        if n:
            windows.setdefault(n, set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    left = {i: d for i, d in left.items() if not contaminated(d[0], windows)}
    left = {i: (redacted(t), s) for i, (t, s) in left.items()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (t, _) in left.items()}

    got = {r.doc_id: r for r in cp.run(spark, SF).collect()}
    assert set(got) == set(left) and {i: r.size for i, r in got.items()} == size

    sums, taken = Counter(), Counter()
    for i, (_, s) in left.items():
        sums[s] += size[i]
        taken[s] += got[i].taken
        assert got[i].taken == got[i].copies * size[i] and 0 <= got[i].copies <= 2
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, share = {}, set(names), 1.5 * sum(sums.values())
    while over := [s for s in open_ if share * weight[s] / sum(weight[x] for x in open_) > 2 * sums[s]]:
        target |= {s: 2.0 * sums[s] for s in over}
        share -= sum(2.0 * sums[s] for s in over)
        open_ -= set(over)
    target |= {s: share * weight[s] / sum(weight[x] for x in open_) for s in open_}
    for i, (_, s) in left.items():
        assert got[i].source_size == sums[s] and abs(got[i].target - target[s]) < 1e-6 * target[s] + 1e-9
    for s in names:
        assert abs(taken[s] - target[s]) <= max(size[i] for i, d in left.items() if d[1] == s)
