"""Fixpoints as loops of DataFrame rounds. Each round is written to the shared folder, which cuts its lineage."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, written

__all__ = ["discard", "fixpoint", "written"]


def fixpoint(start: DataFrame, keys: list[str], step: Callable[[DataFrame], DataFrame], limit: int | None = None) -> DataFrame:
    """Least cost for each key. start: keys, cost, parent and any further columns; step: the same columns, reached from the rows given (those that
    improved in the last round). Of equal costs the earlier round stays, within a round the least (parent, further columns). Rounds go on until nothing
improves; where a limit is given, rows that still improve then are an error.

    A round writes only the rows that improve. The state is the set of these tables: a candidate is held against the least cost of its own key
    there, so rounds of few candidates read the state but shuffle little of it."""
    rest = [c for c in start.columns if c not in keys]
    pack = lambda df, n: df.select(*keys, F.struct(F.col("cost"), F.lit(n).alias("round"), *(F.col(c) for c in rest if c != "cost")).alias("s")).groupBy(*keys).agg(F.min("s").alias("s"))
    rounds = [written(pack(start, 0))]
    while True:
        fresh = rounds[-1].select(*keys, *(F.col(f"s.{c}").alias(c) for c in rest))
        if fresh.limit(1).count() == 0:
            break
        n = len(rounds)
        if limit is not None and n > limit:
            raise RuntimeError(f"costs still improve after {limit} rounds")
        found = written(pack(step(fresh), n))
        state = reduce(DataFrame.unionByName, rounds).select(*keys, F.col("s.cost").alias("least"))
        least = state.join(found.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.min("least").alias("least"))
        rounds.append(written(found.join(least, keys, "left").where("least is null or s.cost < least").drop("least")))
        discard(found)
    best = reduce(DataFrame.unionByName, rounds).groupBy(*keys).agg(F.min("s").alias("s"))
    return best.select(*keys, *(F.col(f"s.{c}").alias(c) for c in rest))
