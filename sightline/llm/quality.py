"""Quality rules under weak supervision.

Rules vote good (+1), bad (-1) or abstain (0) on each document. The corpus is reduced to counts by vote pattern (at most 3 to the
number of rules); expectation-maximisation over these counts, on the driver, estimates each rule's accuracy and the share
of good documents; the posterior probability of quality replaces an all-must-pass filter. DataFrame functions only:
statistics and votes stay in one row, and the one shuffle is that of the pattern counts. The rates that EM starts from count as PRIOR_DOCS documents
of either class, whatever the corpus holds, so they fade as it grows.

Defined results: null and empty texts have no words and fail the base rule; repeated rows are judged alike, each for itself;
an empty table gives an empty result; columns besides id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WS, materialize, table

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
#: Documents of either class that the built-in rates stand for.
PRIOR_DOCS = 10
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def statistics(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys and STATS of whole texts, and further counts that rules use."""
    df = docs.select(*(F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)), F.coalesce(F.col(text), F.lit("")).alias("t"))
    df = df.withColumn("w", F.array_remove(F.split("t", f"[{WS}]+", -1), ""))
    df = df.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0))
    # Hashes of the 5-word windows; a window that comes twice has an equal neighbour in sorted order.
    at = lambda i, j: F.get(F.col("w"), i + j)
    df = df.withColumn("h", F.when(F.size("w") >= 6, F.transform(F.sequence(F.lit(0), F.size("w") - 5), lambda i: F.xxhash64(*(at(i, j) for j in range(5))))))
    twice = F.size(F.array_distinct("h")) < F.size("h")
    df = df.withColumn("st", F.when(twice, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda i, j: F.coalesce(F.get(F.col("st"), i)["x"] == F.get(F.col("st"), j)["x"], F.lit(False))
    twins = F.filter("st", lambda v, i: same(i, i + 1) | ((i > 0) & same(i, F.greatest(i - 1, F.lit(0)))))
    df = df.withColumn("pos", F.when(F.col("st").isNotNull(), F.sort_array(F.transform(twins, lambda v: v["i"]))))
    covered = F.aggregate(F.transform("pos", lambda p, i: F.least(F.lit(5), F.coalesce(F.get(F.col("pos"), i + 1) - p, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    solid = F.translate(F.col("t"), BLANKS, "")
    size = lambda c: c.cast("long")
    return df.select(
        *(F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)),
        size(F.size("w")).alias("n_words"), size(F.length(solid)).alias("word_chars"),
        size(F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).alias("n_symbols"),
        size(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), size(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"),
        size(F.size("lines")).alias("n_lines"), size(F.length("t") - F.length(F.translate("t", "0123456789", ""))).alias("n_digits"),
        size(F.size(F.array_distinct("w"))).alias("n_distinct"),
    )


def vote(bad: Column, good: Column | None = None) -> Column:
    out = F.when(bad, -1)
    return (out if good is None else out.when(good, 1)).otherwise(0)


def votes() -> list[Column]:
    """The rules. Most only know bad text when they see it and abstain on the rest; a few know good text too."""
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    mean = F.col("word_chars") / n
    return [
        vote(F.col("n_words") < 10),
        vote((mean < 2) | (mean > 15)),
        vote(F.col("n_symbols") / n > 0.1, (F.col("n_symbols") / n < 0.01) & (F.col("n_words") >= 10)),
        vote(F.col("n_symbols") / chars > 0.05),
        vote((F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") / lines > 0.3)),
        vote(F.col("n_repeat_words") / n > 0.2, (F.col("n_repeat_words") == 0) & (F.col("n_words") >= 10)),
        vote((F.col("n_words") >= 10) & (F.col("n_distinct") / n < F.when(F.col("n_words") < 100, 0.5).otherwise(0.15))),
        vote(F.col("n_digits") / chars > 0.2),
    ]


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50, strength: float = PRIOR_DOCS) -> dict:
    """EM: each rule has a rate of bad, no and good votes under either class. Starts from rules that are mostly right, and
    `strength` pseudo-counts of the same kind keep rates above zero and the classes from changing places."""
    r = patterns.shape[1]
    prior = np.zeros((2, r, 3))
    prior[0], prior[1] = (0.4, 0.45, 0.15), (0.02, 0.58, 0.4)
    rate, good, total = prior.copy(), 0.8, max(float(counts.sum()), 1.0)

    def posterior() -> np.ndarray:
        logs = [np.log(rate[c][np.arange(r), patterns + 1]).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] + np.log(1 - good) - logs[1] - np.log(good), -700, 700)))

    for _ in range(rounds if len(counts) else 0):
        p = posterior()
        for c, q in ((0, (1 - p) * counts), (1, p * counts)):
            for v in range(3):
                rate[c, :, v] = ((patterns == v - 1) * q[:, None]).sum(axis=0) + strength * prior[c, :, v]
            rate[c] /= rate[c].sum(axis=1, keepdims=True)
        good = float(np.clip((p * counts).sum() / total, 0.01, 0.99))
    return {"weights": np.log(rate[1] / rate[0]), "bias": float(np.log(good / (1 - good))), "good": good, "rate": rate}


def judge(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", threshold: float = 0.5) -> DataFrame:
    """keys, STATS, votes, base_failed, quality (posterior) and kept."""
    df = statistics(docs, keys, text)
    df = materialize(df.withColumn("votes", F.array(*votes())), "votes")
    # At most 3^rules rows: the bound of what comes to the driver.
    got = df.groupBy("votes").count().collect()
    model = estimate(np.array([x["votes"] for x in got], int).reshape(len(got), len(votes())), np.array([x["count"] for x in got], float))
    table_ = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in model["weights"]))
    score = F.aggregate(F.transform("votes", lambda v, i: F.get(F.get(table_, i), v + 1)), F.lit(float(model["bias"])), lambda a, x: a + x)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    df = df.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-score)))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = judge(table(spark, sf_dir, "documents"))
    return df.select("doc_id", *STATS, "base_failed", "kept", "quality")
