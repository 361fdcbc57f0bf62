"""Connected components of any number of edges by alternating stars, in O(log n) rounds of joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, written

#: Shares of a node's edges that a round looks at apart before they meet, so that a node with very many is not one task's work.
SALTS = 32


def stars(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it reaches) for each node of the edges u, v.

    Skew: least neighbours are sums with map-side parts. An edge learns its node's least neighbour by a join that repeats these, one row for
    each node, SALTS times, so the edges of the busiest node spread over as many tasks."""
    pairs = lambda df: df.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS))

    def told(df: DataFrame, least: DataFrame) -> DataFrame:
        return df.withColumn("salt", salt).join(least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["u", "salt"]).drop("salt")

    now = written(pairs(edges), "edges")
    seen = state(now)
    while seen[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(pairs(told(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = told(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        before, old = seen, now
        now = written(pairs(small), "edges")
        seen = state(now)
        discard(large, old)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
