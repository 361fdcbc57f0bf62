"""Language-model scoring by partial matching over bytes (PPM), and a word unigram base.

Training counts byte n-grams of order `ORDER` + 1 over all training documents (array arithmetic in the tasks, sums in Spark). The context trie
holds every context and every symbol that training has seen, so it grows with the corpus. Escape estimation is method C: a context escapes in
proportion to its number of distinct symbols. Symbol exclusion: what a longer context has seen does not count in the shorter one. As
what a context has seen its suffix has seen too, exclusion leaves two numbers for each context, and a text is scored by
hash look-ups of whole batches.

The probability of a gram is a function of the gram alone. So the distinct grams of all documents, with their training counts, are dealt to blocks of
about `block` cells by the two bytes before a symbol: all cells that share these bytes are in one block, and with the contexts of up to one byte (at
most 2^16 + 2^8 cells, sent to every task) a block finds the probabilities of its grams alone, in one task, and writes them. No block passes
through the driver and none is repeated. The grams of one pair of bytes are never divided: at most 2^24 cells.

Texts meet the probabilities in two ways: the most frequent grams, at most `head_grams`, go to the tasks as a hash table; the others, each rare, are
joined by gram and summed by row, so no frequent gram is ever a join key. A text is read once for the counts and once for its score, whatever the
size of the trie.

Base: each token's training count. The most frequent tokens, at most `head`, go to the tasks by broadcast; the other
tokens, each rare, are joined by token, so no frequent token is ever a join key. Both parts are exact.

Defined results: null and empty texts have one token (the end) and a log probability of 0; equal rows are scored each for itself; with no
training rows every count is 0 and bytes are uniform; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, fold, folded, in_batches, materialize, table

#: The end token cannot be a word: it has white space in it.
END = b"\n"
ORDER, BLOCK, HEAD, HEAD_GRAMS = 4, 400_000, 200_000, 2_000_000
#: Bytes before a symbol by which cells are dealt to blocks.
DEALT = 2
MOD, OUT = 7, 2


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


def low(order: int) -> np.uint64:
    """Mask of the last `order` bytes."""
    return np.uint64((1 << 8 * order) - 1)


def grams(data: bytes, order: int = ORDER) -> np.ndarray:
    """For each byte, it and the `order` bytes before it (line ends before the text) as one number."""
    b = np.frombuffer(END * order + data, np.uint8).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for j in range(order + 1):
        out = (out << np.uint64(8)) | b[j : j + len(data)]
    return out


def add_up(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of n for each."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def count_grams(docs: DataFrame, text: str = "text", training: str = "training") -> DataFrame:
    """gram (long), n: over training rows, m: over the others. Each task sums what it has before anything moves, in bounded memory."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # a key is a gram and one bit: whether its row is none of training's

        def merge() -> None:
            nonlocal keys, n
            new = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            keys, n = add_up(np.concatenate([keys, new[0]]), np.concatenate([n, new[1]]))

        def rows() -> pa.RecordBatch:
            other = (keys & np.uint64(1)).astype(bool)
            return pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(1)).astype(np.int64)), pa.array(np.where(other, 0, n)), pa.array(np.where(other, n, 0))], names=["gram", "n", "m"])

        for b in batches:
            for t, train in zip(b.column(text), b.column(training).to_pylist(), strict=True):
                data = (t.as_py() or "").encode("utf-8", "replace")
                for i in range(0, len(data), 1 << 20):
                    g = grams(data[max(0, i - ORDER) : i + (1 << 20)])[min(i, ORDER) :]
                    held.append((g << np.uint64(1)) | np.uint64(not train))
                    size += len(g)
                    if size > 4_000_000:
                        merge()
                        size = 0
                        if len(keys) > 2_000_000:
                            yield rows()
                            keys, n = keys[:0], n[:0]
        if held:
            merge()
        if len(keys):
            yield rows()

    return in_batches(docs.select(text, training), count, "gram long, n long, m long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


class Index:
    """Place of each of these distinct keys, by an open hash table at most half full."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(4, (2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = self.home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            rest = self.slots[at] != left
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is not held."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self.home(keys)
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(open_):
            at_ = (at[open_] + 1) & ((1 << self.bits) - 1)
            at[open_] = at_
            out[open_] = got = self.slots[at_]
            open_ = open_[(got >= 0) & (self.keys[got] != keys[open_])]
        return out


class Level:
    """Contexts of one order. gram: distinct, ascending; n: their counts; below: the level of one order less, holding every shorter context."""

    def __init__(self, order: int, gram: np.ndarray, n: np.ndarray, below: Level | None):
        self.gram, self.n = gram, n
        self.ctx, first = np.unique(gram >> np.uint64(8), return_index=True)
        self.total = np.add.reduceat(n, first) if len(first) else np.zeros(0)
        self.seen = np.diff(np.append(first, len(gram)))
        base = np.log10(self.total + np.where(self.seen < 256, self.seen, 0))
        logn = np.log10(n)
        self.logn, self.logp = logn.astype(np.float32), (logn - np.repeat(base, self.seen)).astype(np.float32)
        self.escape = (np.log10(self.seen) - base).astype(np.float32)
        # The next shorter context without what this one has seen: its denominator, and its escape from there.
        self.under = self.under_escape = np.zeros(len(first), np.float32)
        if below is not None and len(first):
            hidden = np.add.reduceat(below.n[np.searchsorted(below.gram, gram & low(order))], first)
            suffix = np.searchsorted(below.ctx, self.ctx & low(order - 1))
            left, kinds = below.total[suffix] - hidden, below.seen[suffix] - self.seen
            some = kinds > 0
            self.under = np.log10(np.where(some, left + np.where(below.seen[suffix] < 256, kinds, 0), 1)).astype(np.float32)
            self.under_escape = np.log10(np.where(some, kinds / np.maximum(left + kinds, 1), 1)).astype(np.float32)

    @cached_property
    def cells(self) -> Index:
        return Index(self.gram)

    @cached_property
    def contexts(self) -> Index:
        return Index(self.ctx)


class Trie:
    """One block. short: grams of the contexts of fewer than `shared` bytes, all of them; gram: those of this block; either with counts."""

    def __init__(self, short: np.ndarray, short_n: np.ndarray, gram: np.ndarray, n: np.ndarray, shared: int = 3):
        self.levels: list[Level] = []
        for order in range(ORDER + 1):
            keys, sums = add_up(*((short & low(order + 1), short_n) if order < shared else (gram & low(order + 1), n)))
            self.levels.append(Level(order, keys, sums.astype(float), self.levels[-1] if order else None))
        self.unseen = -math.log10(max(1, 256 - len(self.levels[0].gram)))

    def logs(self, g: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram after the bytes before it."""
        out, at = np.zeros(len(g)), np.arange(len(g))
        came, under, under_escape = np.zeros(len(g), bool), np.zeros(len(g), np.float32), np.zeros(len(g), np.float32)
        for order in range(ORDER, -1, -1):
            level, key = self.levels[order], g & low(order + 1)
            cell = level.cells.find(key)
            hit = cell >= 0
            found = cell[hit]
            out[at[hit]] += np.where(came[hit], level.logn[found] - under[hit], level.logp[found])
            miss = ~hit
            g, at, came = g[miss], at[miss], came[miss]
            if not len(at):
                return out
            context = level.contexts.find(key[miss] >> np.uint64(8))
            known = context >= 0
            if len(level.ctx):
                out[at] += np.where(came, under_escape[miss], np.where(known, level.escape[context], 0))
                under, under_escape = np.where(known, level.under[context], 0), np.where(known, level.under_escape[context], 0)
            came = known
        out[at] += self.unseen
        return out


def block_of(gram: F.Column, blocks: int) -> F.Column:
    """The block of a gram by the DEALT bytes before its last."""
    suffix = F.shiftright(gram, 8).bitwiseAND(F.lit((1 << 8 * DEALT) - 1))
    return F.shiftright((suffix * F.lit(2654435761)).bitwiseAND(F.lit(0xFFFFFFFF)), 8) % blocks


def probabilities(counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """gram, logp (log10), f (how often it occurs in all rows), block by block. counts: gram, n, m."""
    spark = counts.sparkSession
    blocks = max(1, -(-counts.count() // block))
    mask = F.lit((1 << 8 * DEALT) - 1)
    got = counts.where("n > 0").groupBy(F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.sum("n").alias("n")).toArrow()  # at most 2^16 rows
    short = spark.sparkContext.broadcast((got.column("gram").to_numpy().astype(np.uint64), got.column("n").to_numpy()))

    def find(t: pa.Table) -> pa.Table:
        gram, n, m = (t.column(c).to_numpy() for c in ("gram", "n", "m"))
        order = np.argsort(gram)
        gram, n, m = gram[order].astype(np.uint64), n[order], m[order]
        seen = n > 0
        trie = Trie(*short.value, gram[seen], n[seen], shared=DEALT)
        logp = np.zeros(len(gram))
        logp[seen] = trie.levels[ORDER].logp
        logp[~seen] = trie.logs(gram[~seen])
        return pa.table({"gram": gram.astype(np.int64), "logp": logp, "f": n + m})

    return counts.withColumn("block", block_of(F.col("gram"), blocks)).groupBy("block").applyInArrow(find, "gram long, logp double, f long")


def least_of_head(counts: DataFrame, f: str, head: int) -> int:
    """The least count of the head: at most `head` rows of counts have it or more in column f. From the number of rows by size class (a few hundred)."""
    sizes = counts.groupBy(F.floor(F.log2(F.col(f).cast("double")) * 16).alias("size")).agg(F.count("*").alias("rows"), F.min(f).alias("least"), F.max(f).alias("most")).orderBy(F.desc("size")).collect()
    edge, rows = (sizes[0]["most"] if sizes else 0) + 1, 0
    for x in sizes:
        if (rows := rows + x["rows"]) > head:
            break
        edge = x["least"]
    return edge


class Head:
    """The most frequent grams and their logarithms."""

    def __init__(self, gram: np.ndarray, logp: np.ndarray):
        self.index, self.logp = Index(gram), logp

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, pa.ListArray]:
        """For each text the sum of the logarithms held, and the grams not held, in bounded memory besides these."""
        out, held, rows, size = np.zeros(len(texts)), [], [], 0
        tail, tail_rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def flush() -> None:
            g = np.concatenate(held)
            at = self.index.find(g)
            logs = np.where(at >= 0, self.logp[at], 0.0) if len(self.logp) else np.zeros(len(g))
            size_ = [len(x) for x in held]
            np.add.at(out, rows, np.add.reduceat(logs, np.append(0, np.cumsum(size_)[:-1])))
            miss = np.flatnonzero(at < 0)
            tail.append(g[miss].astype(np.int64))
            tail_rows.append(np.repeat(np.array(rows), size_)[miss])
            held.clear()
            rows.clear()

        for row, data in enumerate(texts):
            for i in range(0, len(data), 1 << 18):
                held.append(grams(data[max(0, i - ORDER) : i + (1 << 18)])[min(i, ORDER) :])
                rows.append(row)
                size += len(held[-1])
                if size >= 1 << 20:
                    flush()
                    size = 0
        if held:
            flush()
        ends = np.searchsorted(np.concatenate(tail_rows), np.arange(len(texts) + 1))
        return out, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tail)))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mod: int = MOD, out: int = OUT, head: int = HEAD, block: int = BLOCK, head_grams: int = HEAD_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    in_training = folded(F.col("doc_id"), mod) != out
    training = rows.where(in_training)
    grams_ = materialize(count_grams(rows.select("text", in_training.alias("training"))), "grams")
    cells = materialize(probabilities(grams_, block), "cells")
    discard(grams_)
    gram_edge = least_of_head(cells, "f", head_grams)
    top = cells.where(F.col("f") >= gram_edge).select("gram", "logp").toArrow()  # at most head_grams rows
    frequent = spark.sparkContext.broadcast(Head(top.column("gram").to_numpy().astype(np.uint64), top.column("logp").to_numpy()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "n"])
            held.clear()
            return b

        for b in batches:
            for t in b.column("text"):
                held.update(tokens(t.as_py()))
                if len(held) > 300_000:
                    yield flush()
        if held:
            yield flush()

    counts = in_batches(training.select("text"), count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "tokens")
    known, total = counts.agg(F.count("*"), F.sum("n")).first()
    total = total or 0
    edge = least_of_head(counts, "n", head)
    top = counts.where(F.col("n") >= edge).toPandas()
    rare_left = len(top) < known
    held = spark.sparkContext.broadcast(dict(zip(map(bytes, top["token"]), np.log10(top["n"].to_numpy(float) + 1).tolist(), strict=True)))
    shift = math.log10(total + known + 1)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = held.value.get
        for b in (big.slice(i, 1000) for big in batches for i in range(0, big.num_rows, 1000)):
            ids, cols = b.column("doc_id"), {k: [] for k in ("n_tokens", "n_known", "base", "rare")}
            texts = []
            for t in b.column("text"):
                t = t.as_py() or ""
                words = tokens(t)
                logs = [get(w) for w in words]
                hits = [x for x in logs if x is not None]
                cols["rare"].append([w for w, x in zip(words, logs, strict=True) if x is None] if rare_left else [])
                cols["n_tokens"].append(len(words))
                cols["n_known"].append(len(hits))
                cols["base"].append(math.fsum(hits))
                texts.append(t.encode("utf-8", "replace"))
            sums, tail = frequent.value.score(texts)
            kinds = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "rare": pa.list_(pa.binary())}
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, kinds[k]) for k, v in cols.items()), pa.array(sums), tail], names=["doc_id", *cols, "score", "tail"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    part = in_batches(rows, first, f"doc_id {id_type}, n_tokens long, n_known long, base double, rare array<binary>, score double, tail array<bigint>")
    # Written once, so that the row number stays what it is whatever is lost later.
    part = materialize(part.withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = part.select("row", F.explode("rare").alias("token"))
    tail = counts.where(F.col("n") < edge).withColumnRenamed("n", "c")
    more = rare.join(tail, "token").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("logs"))
    seldom = part.select("row", F.explode("tail").alias("gram")).join(cells.where(F.col("f") < gram_edge).select("gram", "logp"), "gram").groupBy("row").agg(F.sum("logp").alias("seldom"))
    done = part.drop("rare", "tail").join(more, "row", "left").join(seldom, "row", "left")
    value = F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(shift)
    return done.select("doc_id", (folded(F.col("doc_id"), mod) == out).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), value.alias("base_score"), (F.col("score") + F.coalesce("seldom", F.lit(0.0))).alias("score"))


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def brute(docs: list[tuple]) -> list[tuple]:
    """The base by its definition, for tests: doc_id, held_out, n_tokens, n_known, train_tokens, base_score."""
    c: Counter = Counter()
    for d, t in docs:
        if fold(d, MOD) != OUT:
            c.update(tokens(t))
    n, v = c.total(), len(c)
    out = []
    for d, t in docs:
        w = tokens(t)
        out.append((d, fold(d, MOD) == OUT, len(w), sum(x in c for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    return out
