"""SimHash near-duplicates by tiled exact comparison.

Fingerprints within `radius` bits of each other agree on at least one of radius + 1 bit blocks, so every distinct fingerprint goes
to one bucket for each of its blocks (its block number and the block's bits). A bucket is cut into tiles of about `tile` fingerprints; a
bucket of one tile is compared with itself, a larger one as pairs of tiles, each pair a row of its own, so a hot bucket spreads
over tasks. Within a pair numpy sorts by population count, skips the sub-tile pairs whose population counts differ beyond the radius, and
compares the rest by exclusive-or and bit counts. The comparison is exact: no cap, no lost link. A pair of tiles returns a
spanning forest of its links, never all pairs. Components are found in Spark by alternating large-star and small-star steps, each
cut by a written table; no fingerprints, links or components come to the driver.

Defined results: null and empty texts have fingerprint zero and are linked like any other; equal rows are returned as often as
they come; a component whose ids are all null has a null id; an empty table gives an empty result; columns besides id and text are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stars import stars
from ._common import in_batches, materialize, table

SHINGLE, SEED, RADIUS, TILE, SUB = 3, 42, 2, 1024, 256


def fingerprint(text: str | None) -> int:
    """64 bits, unsigned: each set if in over half of the shingles' hashes."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    line = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w)) + 1
    end = np.cumsum(size) - 1
    k = min(SHINGLE, len(w))
    start = end - size + 1
    digest = xxhash.xxh64_intdigest
    n = len(w) - k + 1
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(start[:n].tolist(), end[k - 1 :].tolist(), strict=True)), np.uint64, n)
    bits = np.zeros(64, np.int64)
    for i in range(0, n, 65536):  # bounded memory for any text
        bits += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return in_batches(rows, hash_rows, f"doc_id {id_type}, fp long")


def links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into a followed by b, or into a alone) of fingerprints within the radius, by sub-tiles."""
    own = b is None
    b = a if own else b
    ia, ib = np.argsort(np.bitwise_count(a), kind="stable"), np.argsort(np.bitwise_count(b), kind="stable")
    a, b = a[ia], b[ib]
    pa_, pb = np.bitwise_count(a).astype(int), np.bitwise_count(b).astype(int)
    left, right = [], []
    for i in range(0, len(a), SUB):
        for j in range(i if own else 0, len(b), SUB):
            x, y = slice(i, i + SUB), slice(j, j + SUB)
            if pb[y][0] - pa_[x][-1] > radius or pa_[x][0] - pb[y][-1] > radius:
                continue
            u, v = np.nonzero(np.bitwise_count(a[x, None] ^ b[None, y]) <= radius)
            left.append(ia[u + i])
            right.append(ib[v + j] + (0 if own else len(a)))
    if not left:
        return np.zeros(0, int), np.zeros(0, int)
    u, v = np.concatenate(left), np.concatenate(right)
    return u[u != v], v[u != v]


def forest(nodes: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as stars: each linked node with the smallest node that these links reach."""
    label = nodes.copy()
    while True:
        m = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, m)
        np.minimum.at(new, v, m)
        if (new == label).all():
            break
        label = new
    own = label != nodes
    return nodes[own], label[own]


def near_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """u, v (u > v): stars of the links between the distinct fingerprints of column fp."""
    n, width = radius + 1, -(-64 // (radius + 1))
    block = lambda i: F.shiftrightunsigned("fp", i * width).bitwiseAND((1 << min(width, 64 - i * width)) - 1)
    rows = prints.select("fp", F.posexplode(F.array(*(block(i) for i in range(n)))).alias("block", "value"))
    # Buckets of one fingerprint go; the others learn into how many tiles they are cut.
    tiles = rows.groupBy("block", "value").count().where("count > 1").select("block", "value", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    rows = rows.join(tiles, ["block", "value"])
    packed = rows.groupBy("block", "value", "tiles", F.pmod(F.xxhash64("fp"), F.col("tiles")).alias("t")).agg(F.collect_list("fp").alias("fps"))
    single = packed.where("tiles = 1").select(F.col("fps").alias("a"), F.lit(None).cast("array<bigint>").alias("b"))
    many = materialize(packed.where("tiles > 1"), "tiles")
    other = many.select("block", "value", F.col("t").alias("t2"), F.col("fps").alias("b"))
    pairs = many.join(other, ["block", "value"]).where("t <= t2").select(F.col("fps").alias("a"), F.when(F.col("t") < F.col("t2"), F.col("b")).alias("b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_u, out_v = [], []
            for x, y in zip(batch.column("a"), batch.column("b"), strict=True):
                a = x.values.to_numpy(zero_copy_only=False)
                b = y.values.to_numpy(zero_copy_only=False) if y.is_valid else None
                if b is None and len(a) == 2 and (int(a[0] ^ a[1]) & (1 << 64) - 1).bit_count() > radius:
                    continue  # most buckets: two fingerprints that share a block by chance
                u, v = links(a.view(np.uint64), None if b is None else b.view(np.uint64), radius)
                if len(u):
                    s, t = forest(a if b is None else np.concatenate([a, b]), u, v)
                    out_u.append(s)
                    out_v.append(t)
            if out_u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_u)), pa.array(np.concatenate(out_v))], names=["u", "v"])

    return in_batches(single.unionByName(pairs), compare, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it reaches) for each node of the edges u, v; alternating stars, O(log n) rounds."""
    return stars(edges)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the smallest id reachable) of each row."""
    prints = materialize(fingerprints(docs, doc_id, text), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(least.select("fp"), radius, tile)).withColumnRenamed("node", "fp")
    named = least.join(roots.unionAll(roots.select(F.col("root").alias("fp"), "root").distinct()), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialize(named, "roots")
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.join(first, "root").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = near_duplicates(table(spark, sf_dir, "documents"))
    return df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
