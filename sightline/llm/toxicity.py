"""Toxicity: maximum-scoring segment search.

Training: features of words (the word, and its prefixes of 4 to 6 letters for inflected forms) are counted by document over labelled rows;
log-odds with a Dirichlet prior proportional to each feature's overall rate weigh the features that speak significantly for toxicity or against it.
Copies of a text are learned from once. Every word scores its log-odds (0 if nothing significant is known of it) less a constant, so that the mean is
below 0. Ruzzo and Tompa's linear-time scan then finds every maximal segment of a text, and extreme-value statistics (lambda from the scores of all
words of labelled clean rows that were not counted, K from their best segments) turn a segment's score into the
number of such segments that a clean text of the same length would show by chance. A logistic curve over that figure, fitted
on the same rows kept apart, gives the probability.

Bounds: at most about `max_train` labelled rows are learned from (all of them below that, else those with the lowest hash of the id); features
with under `min_docs` documents, and those that say nothing significant, are left out in the tasks, which bounds the model by the sample. Scoring covers every row and whole texts.

Defined results: null and empty texts get the probability of a text without passages; a null id is scored but never learned from; contradicting labels
of one id count each; without toxic or without clean rows to learn from every score is 0; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import folded, in_batches, materialize, table

MOD, OUT, THRESHOLD = 4, 2, 0.3
MAX_TRAIN, MIN_DOCS, MIN_Z, PRIOR, PENALTY = 200_000, 3, 3.7, 10.0, 0.4
PREFIXES = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")


def features(words: set[str]) -> set[str]:
    out = set(words)
    for k in PREFIXES:
        out.update(w[:k] + "*" for w in words if len(w) > k)
    return out


def segments(scores: list[tuple[int, float]], penalty: float) -> list[tuple[int, int, float]]:
    """Ruzzo-Tompa: all maximal scoring segments (first, last, score) of a sequence with these (position, score) and -penalty elsewhere."""
    # [first, last, left total, right total, the nearest segment before it with a lower left total or -1]: a search skips those in between, which makes it linear.
    found: list[list] = []
    total, last = 0.0, -1
    for pos, x in scores:
        total -= penalty * (pos - last - 1)
        if x <= 0:
            total, last = total + x, pos
            continue
        first, left = pos, total
        total, last = total + x, pos
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append([first, pos, left, total, j])
                break
            first, _, left, _, before = found[j]
            del found[j:]
            j = before
    return [(a, b, r - l) for a, b, l, r, _ in found]


class Model:
    """weights: of features; lam, k: of the extreme-value law; a, b: of the logistic curve."""

    def __init__(self, weights: dict[str, float], penalty: float = PENALTY):
        self.weights, self.penalty = weights, penalty
        self.lam, self.k, self.a, self.b = 1.0, 0.1, -20.0, 0.0
        self.memo: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def word(self, w: str) -> float:
        """The word's own weight, else that of its longest prefix that has one, else 0."""
        if (x := self.memo.get(w)) is None:
            x = self.weights.get(w)
            for n in reversed(PREFIXES):
                if x is None and len(w) > n:
                    x = self.weights.get(w[:n] + "*")
            if len(self.memo) > 200_000:
                self.memo.clear()
            x = self.memo[w] = x or 0.0
        return x

    def marks(self, text: str | None) -> tuple[int, list[tuple[int, float]]]:
        """The number of words, and (place, score) of those with a weight; all others score -penalty."""
        words = WORD.findall((text or "").lower())
        memo, word, cost = self.memo, self.word, self.penalty
        return len(words), [(i, x - cost) for i, w in enumerate(words) if (x := memo.get(w) if w in memo else word(w))]

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        n, marks = self.marks(text)
        return n, segments(marks, self.penalty) if marks else []

    def surprise(self, n: int, best: float) -> float:
        """-ln of the expected number of chance segments at least that good in n clean words; 0 at least."""
        return max(0.0, self.lam * best - math.log(max(self.k * n, 1e-9))) if best > 0 else 0.0

    def combined(self, n: int, scores: list[float]) -> float:
        """Surprise of the best passage, and with it that of every further significant one, at a falling share."""
        s = sorted((self.surprise(n, x) for x in scores), reverse=True)
        return math.log1p(min(sum(x / (i + 1) for i, x in enumerate(s) if i == 0 or x > 3), 1e6))

    def evidence(self, text: str | None) -> float:
        n, found = self.passages(text)
        return self.combined(n, [x for _, _, x in found])

    def probability(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.a + self.b * self.evidence(text)))))


def weigh(counts: DataFrame, n_toxic: int, n_clean: int, prior: float = PRIOR, min_z: float = MIN_Z, min_docs: int = MIN_DOCS) -> DataFrame:
    """f, x from counts (f, a toxic and c clean documents): log-odds with a prior of `prior` documents spread as the feature is overall; kept if the signed
    root of the likelihood ratio against that overall rate is over min_z either way, which holds for small counts too."""
    a, c, rate = F.col("a"), F.col("c"), n_toxic / (n_toxic + n_clean)
    part = lambda n, share: F.when(n > 0, n * F.ln(F.when(n > 0, n / ((a + c) * share)).otherwise(F.lit(1.0)))).otherwise(F.lit(0.0))
    p = prior * (a + c) / (n_toxic + n_clean)
    x = F.ln((a + p) / (n_toxic + prior - a - p)) - F.ln((c + p) / (n_clean + prior - c - p))
    return counts.where((a + c >= min_docs) & ((a >= min_docs) | (a < (a + c) * rate)) & (2 * (part(a, rate) + part(c, 1 - rate)) > min_z**2)).select("f", x.alias("x"))


def root(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive lambda with sum of shares * exp(lambda * score) = 1 (the mean score is below 0)."""
    lo, hi = 0.0, 1.0
    value = lambda x: float((shares * np.exp(np.minimum(x * scores, 700))).sum())
    while value(hi) < 1 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 1 else (lo, mid)
    return lo


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-a - b x)), by Newton's method."""
    z, w = np.stack([np.ones(len(x)), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (y - p) - ridge * w)
        w += np.clip(step, -3, 3)
    return float(w[0]), max(0.0, float(w[1]))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, min_docs: int = MIN_DOCS, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    spark = docs.sparkSession
    ids = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("toxic")).where((folded(F.col(doc_id), MOD) != OUT) & F.col("toxic").isNotNull() & F.col("id").isNotNull())
    n = ids.count()
    if n > max_train:
        ids = ids.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * max_train / n))
    # The sample's size is bounded by max_train, so it may go to every task. Of equal texts with equal labels one is learned from.
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    once = texts.join(F.broadcast(ids), "id").groupBy(F.xxhash64("text").alias("hash"), "toxic").agg(F.min("id").alias("id")).select("id", "toxic")
    rows = texts.join(F.broadcast(materialize(once, "sample")), "id").select(F.col("text"), F.col("toxic").cast("int").alias("toxic"), (folded(F.col("id"), 5 * MOD) < MOD).alias("apart"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            keys = list(held[1] | held[0])
            b = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([held[k].get(f, 0) for f in keys], pa.int64()) for k in (1, 0))], names=["f", "a", "c"])
            held[0].clear()
            held[1].clear()
            return b

        for b in batches:
            for t, y in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
                held[y > 0].update(features(set(WORD.findall((t.as_py() or "").lower()))))
                held[y > 0][""] += 1
                if len(held[0]) + len(held[1]) > 300_000:
                    yield flush()
        if held[0] or held[1]:
            yield flush()

    counts = in_batches(rows.where(~F.col("apart")).select("text", "toxic"), count, "f string, a long, c long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
    counts = materialize(counts, "features")
    sizes = next(((r.a, r.c) for r in counts.where("f = ''").collect()), (0, 0))
    model = Model({r.f: r.x for r in weigh(counts.where("f <> ''"), *sizes, min_docs=min_docs).collect()} if all(sizes) else {})
    held = spark.sparkContext.broadcast(model)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each row kept apart: label, words, and the score of each segment; and, with label -1, how many words of clean rows have a score."""
        m = held.value
        for b in batches:
            out, words = [], Counter()
            for t, y in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
                n_, marks = m.marks(t.as_py())
                out.append((int(y > 0), n_, [x for _, _, x in segments(marks, m.penalty)]))
                if not y > 0:
                    words.update(round(x, 2) for _, x in marks)
                    words[-m.penalty] += n_ - len(marks)
            out += [(-1, k, [x]) for x, k in words.items()]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.float64()))], names=["y", "n", "s"])

    tried = in_batches(rows.where("apart").select("text", "toxic"), apart, "y int, n long, s array<double>").collect()
    words, tried = [(r.s[0], r.n) for r in tried if r.y < 0], [r for r in tried if r.y >= 0]
    y = np.array([r.y for r in tried], float)
    if not all(sizes) or not y.sum() or y.sum() == len(y):
        if model.weights:  # too few rows to calibrate on: a text needs a passage clearly beyond chance
            model.a, model.b = -4.0, 2.0
        return model
    clean = [(r.n, r.s) for r in tried if not r.y]
    shares: Counter = Counter({2.0: 1, -model.penalty: 1})  # one word more that speaks for toxicity, so that there is one, and one that does not
    for x, k in words:
        shares[x] += k
    total = sum(shares.values())
    model.lam = min(2.0, max(0.05, root(np.array(list(shares)), np.array(list(shares.values()), float) / total)))
    best = np.array([max(s, default=0.0) for _, s in clean])
    model.k = float(max(1, (best > 0).sum()) / max(1e-9, (np.array([k for k, _ in clean], float) * np.exp(-model.lam * best)).sum()))
    x = np.array([model.combined(r.n, r.s) for r in tried])
    model.a, model.b = logistic(x, y)
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", with_passages: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, the columns of docs in `keep` and, if asked for, passages: (first word, last word, surprise) of each segment beyond chance."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            texts = [t.as_py() for t in b.column("text")]
            cols = [b.column("doc_id"), pa.array([m.probability(t) for t in texts], pa.float64())]
            if with_passages:
                found = [m.passages(t) for t in texts]
                cols.insert(2, pa.array([[{"first": a, "last": e, "surprise": m.surprise(n, x)} for a, e, x in f if m.surprise(n, x) > 3] for n, f in found], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("surprise", pa.float64())]))))
            yield pa.RecordBatch.from_arrays([*cols, *(b.column(f"kept_{i}") for i in range(len(keep)))], names=[f.name for f in schema])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)))
    found = StructType.fromDDL("score double" + ", passages array<struct<first:int,last:int,surprise:double>>" * with_passages)
    schema = StructType([rows.schema["doc_id"], *found.fields, *rows.schema.fields[2:]])
    out = in_batches(rows, run, schema)
    return out.withColumnsRenamed({f"kept_{i}": c for i, c in enumerate(keep)})


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    df = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return df.select("doc_id", (folded(F.col("doc_id"), MOD) == OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
