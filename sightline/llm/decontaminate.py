"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

The benchmark's windows (13 consecutive words; a shorter item is one window) become 64-bit rolling hashes over word numbers;
documents are scanned batch by batch: words to numbers by one dictionary look-up each, window hashes as array
arithmetic over the whole batch, candidates verified word by word. A hit marks its words.

Bounded broadcast: items are taken in blocks of at most `block_words` words, read one ahead from a streamed benchmark; each block is one pass over the
rows. One block is one pass in one job. Of several, all but the last are jobs of their own that write the hits, (start, end) ranges, of the rows that
have any, so a worker holds one block at a time and texts never move; the last pass meets these hits by row. An item larger than a block is a
block of its own.

Defined results: a null text has no words; a null item id is not listed but its windows count; equal item ids count once;
repeated documents are judged each for itself; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import in_batches, materialize, table

N = 13
BLOCK_WORDS = 2_000_000
#: Documents are scanned together up to so many, or so many bytes of text; a longer one is scanned alone.
BATCH_ROWS, BATCH_BYTES = 256, 4_000_000
#: Bytes of a word stay, A-Z become lower case, all else separates; every byte of a non-ASCII code point is 0x80 or more.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PRIME = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(NORMAL).split()


def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded size."""
    start = held = 0
    for i, n in enumerate(pc.binary_length(b.column("text")).to_pylist()):
        if i > start and (i - start == BATCH_ROWS or held + (n or 0) > BATCH_BYTES):
            yield b.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if b.num_rows > start:
        yield b.slice(start)


class Windows:
    """The windows of a block of items, as arrays: some 70 bytes for each. lengths: by window length the windows' hashes, ascending, the
    windows as rows of word numbers, and the items of window i at owner[first[i] : first[i + 1]]."""

    def __init__(self, items: list[tuple], n: int = N):
        self.number: dict[bytes, int] = {}
        self.items = [str(i) if i is not None else None for i, _ in items]
        parts: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, (_, text) in enumerate(items):
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(text)], np.int32)
            if len(ids):
                parts.setdefault(min(n, len(ids)), []).append((ids, k))
        self.lengths = {}
        for size, found in parts.items():
            grid = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids, size) for ids, _ in found])
            owner = np.concatenate([np.full(len(ids) - size + 1, k, np.int32) for ids, k in found])
            h = np.zeros(len(grid), np.uint64)
            for j in range(size):
                h = h * PRIME + grid[:, j].astype(np.uint64)
            order = np.lexsort((owner, *grid.T, h))
            grid, owner, h = grid[order], owner[order], h[order]
            first = np.flatnonzero(np.append(True, (grid[1:] != grid[:-1]).any(axis=1)))
            self.lengths[size] = (h[first], grid[first], np.append(first, len(owner)), owner)

    def scan(self, docs: list[list[bytes]]) -> tuple[list[list], list[list]]:
        """For each document its merged hit ranges and the ids of the items with occurring windows."""
        number, flat, starts = self.number.get, [], []
        for d in docs:
            starts.append(len(flat))
            flat.extend(number(w, 0) for w in d)
            flat.append(0)
        ids, starts = np.array(flat, np.int64), np.array(starts, np.int64)
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        ranges, found = [[] for _ in docs], [set() for _ in docs]
        for size, (wanted, grid, first, owner) in self.lengths.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            h = np.zeros(len(at), np.uint64)
            for j in range(size):
                h = h * PRIME + ids[at + j].astype(np.uint64)
            row, end = np.searchsorted(wanted, h), np.searchsorted(wanted, h, "right")
            hits = []
            while len(open_ := np.flatnonzero(row < end)):  # once, but for windows that share a hash
                at, row, end = at[open_], row[open_], end[open_]
                same = np.ones(len(at), bool)
                for j in range(size):
                    same &= grid[row, j] == ids[at + j]
                hits.append((at[same], row[same]))
                row = np.where(same, end, row + 1)
            if not hits:
                continue
            at, row = (np.concatenate(x) for x in zip(*hits, strict=True))
            doc = np.searchsorted(starts, at, "right") - 1
            for p, d in zip((at - starts[doc]).tolist(), doc.tolist(), strict=True):
                ranges[d].append((p, p + size))
            for d, i in np.unique(np.stack([doc, row], 1), axis=0).tolist():
                found[d].update(self.items[k] for k in owner[first[i] : first[i + 1]].tolist())
        return ranges, [sorted(x for x in f if x is not None) for f in found]


def merged(ranges: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, ranges)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def blocks(benchmark: DataFrame, block_words: int, item_id: str, text: str) -> Iterator[list[tuple]]:
    """Items in blocks of bounded size, streamed to the driver one partition at a time."""
    block, size = [], 0
    for r in benchmark.select(item_id, text).toLocalIterator():
        n = len(words(r[1]))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block:
        yield block


def with_last(found: Iterator[list[tuple]]) -> Iterator[tuple[list[tuple], bool]]:
    """Each block and whether it is the last, one block ahead; without blocks an empty one."""
    now = next(found, [])
    while now is not None:
        after = next(found, None)
        yield now, after is None
        now = after


def find(docs: DataFrame, benchmark: DataFrame, n: int = N, block_words: int = BLOCK_WORDS, keep_text: bool = False, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, [text], the columns of docs in `keep`, n_words, hits (merged word ranges) and items (sorted ids) of each document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)))
    named = {f"kept_{i}": c for i, c in enumerate(keep)}
    spans, names, parts = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.list_(pa.string()), []
    found = "hits array<struct<a:int,b:int>>, items array<string>"

    def scanned(b: pa.RecordBatch, windows: Windows) -> tuple[list[list[bytes]], list[list], list[list]]:
        docs_ = [words(t) for t in b.column("text").to_pylist()]
        return docs_, *windows.scan(docs_)

    def ranges_of(x: list) -> pa.Array:
        return pa.array([[{"a": a, "b": e} for a, e in merged(r)] for r in x], spans)

    def one_pass(df: DataFrame, windows, only_hits: bool) -> DataFrame:
        keep = [f for f in df.schema.fields if f.name != "text" or (keep_text and not only_hits)]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (part for big in batches for part in slices(big)):
                docs_, ranges, items = scanned(b, windows.value)
                out = pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), pa.array([len(d) for d in docs_], pa.int64()), ranges_of(ranges), pa.array(items, names)], names=[*(f.name for f in keep), "n_words", "hits", "items"])
                yield out.filter(pa.array([bool(r) for r in ranges], pa.bool_())) if only_hits else out

        return in_batches(df, scan, StructType([*keep, *StructType.fromDDL(f"n_words long, {found}").fields]))

    for block, last in with_last(blocks(benchmark, block_words, item_id, item_text)):
        windows = spark.sparkContext.broadcast(Windows(block, n))
        if not last and not parts:
            rows = materialize(rows.withColumn("row_", F.monotonically_increasing_id()), "numbered")
        if not last:
            parts.append(materialize(one_pass(rows.select("row_", "text"), windows, True), "hits"))
            windows.unpersist()
    out = one_pass(rows, windows, False)
    if not parts:
        return out.withColumnsRenamed(named)
    # Rows with hits of several blocks: few and short, without texts.
    earlier = reduce(DataFrame.unionByName, parts).groupBy("row_").agg(F.flatten(F.collect_list("hits")).alias("hits2"), F.flatten(F.collect_list("items")).alias("items2"))
    both = out.join(earlier, "row_", "left").drop("row_")
    fields = [f for f in both.schema.fields if f.name not in ("hits2", "items2")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            more = {c: [v or [] for v in b.column(c).to_pylist()] for c in ("hits", "items", "hits2", "items2")}
            cols = {f.name: b.column(f.name) for f in fields}
            cols["hits"] = ranges_of([[(x["a"], x["b"]) for x in h + k] for h, k in zip(more["hits"], more["hits2"], strict=True)])
            cols["items"] = pa.array([sorted({*i, *k}) for i, k in zip(more["items"], more["items2"], strict=True)], names)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return in_batches(both, merge, StructType(fields)).withColumnsRenamed(named)


def n_hit(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda a, x: a + x["b"] - x["a"])


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def without_spans(text: str | None, hits: list) -> str | None:
    """The text without the characters from the first to the last word of each hit range."""
    if not hits:
        return text
    data = text.encode("utf-8", "replace")
    spots, pos, normal = [], 0, data.translate(NORMAL)
    for w in normal.split():
        pos = normal.index(w, pos)
        spots.append((pos, pos + len(w)))
        pos += len(w)
    out, last = [], 0
    for a, b in hits:
        out.append(data[last : spots[a][0]])
        last = spots[b - 1][1]
    return b"".join([*out, data[last:]]).decode("utf-8", "replace")


def cleaned(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """doc_id and text without contaminated documents (remove = documents), or with every document's hit spans cut out (spans)."""
    df = find(docs, benchmark, keep_text=True, **options).withColumn("n_hit", n_hit(F.col("hits")))
    if remove == "documents":
        return df.where(~contaminated()).select("doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [without_spans(t, [(x["a"], x["b"]) for x in h]) for t, h in zip(b.column("text").to_pylist(), b.column("hits").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return in_batches(df, cut, df.select("doc_id", "text").schema)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("n_hit", n_hit(F.col("hits")))
    return df.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bi AS (SELECT item_id, w, least({N}, len(w)) AS size, unnest(range(1, len(w) - least({N}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS win FROM bi),
di AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM win) WHERE len(w) >= size),
hit AS (SELECT r, i, di.size, item_id FROM di JOIN win ON di.size = win.size AND array_to_string(w[i : i + di.size - 1], ' ') = win.win),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""


def brute(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    """The contract, word by word, for tests."""
    windows = []
    for i, t in items:
        w = words(t)
        size = min(N, len(w))
        windows += [(str(i), tuple(w[k : k + size])) for k in range(len(w) - size + 1 if size else 0)]
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    ids.add(i)
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out
