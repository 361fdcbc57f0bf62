"""Mixing sources to target weights: min-cost flow for overlapping sources.

Documents are aggregated by membership pattern (the set of sources they belong to). Token capacity flows from patterns to
source quotas: a pattern offers its tokens once at cost 0, again at cost 1 and so on (convex repetition costs), so no token is
repeated while an unused one could serve. Flows are found on the driver over patterns by sources; the documents never
leave the executors. Each (pattern, source) flow is then filled by seeded documents: whole copies for all, and for the
remaining part the documents that come first in a seeded order, found by narrowing the order's hash range through
small sums, so that no source is sorted in one task; then the one document whose size is nearest to the gap left is added
or given back.

Defined results: null and empty texts have size 0 and are never short of their share; a null source is a source of its own,
last; ids may have any type that can be cast to a string; rows equal in id, text and source share their place in the order, and where the share
ends among them as many of them are taken as it asks for (which ones makes no difference to the result); an empty table gives an
empty result; columns besides id, text and source are not read.

The driver holds one row for each membership pattern; there are at most MAX_PATTERNS of them, counted first, or it is an error.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, n_words, small, table

SEED = 1234
WEIGHTS = (5, 2, 1)
SHARE, REPEATS = 1.5, 2
#: Bits by which the seeded order is narrowed at a time, and how often: a step sums 256 bins for each pattern.
BITS, STEPS = 8, 3
#: Patterns that the driver's flow is found over (about 1 KB each).
MAX_PATTERNS = 200_000


def targets(sizes: list[float], weights: list[float], total: float, limit: float = REPEATS) -> list[float]:
    """Shares total by weight; what exceeds limit times a size is shared anew among the others until none is above."""
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = total
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > limit * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = float(limit * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def flow(capacity: list[int], members: list[tuple[int, ...]], quota: list[int], repeats: int = REPEATS) -> dict[tuple[int, int], int]:
    """Cheapest flow from patterns to sources. Every unit of layer r (the r-th copy of a pattern's tokens) costs r, and costs lie on the
    arcs out of the origin only; so the cheapest flow is found layer by layer, each by shortest augmenting paths."""
    arcs: list[list[int]] = []  # [to, room]; arc i and i ^ 1 are each other's reverse
    out: list[list[int]] = [[] for _ in range(len(capacity) + len(quota) + 2)]
    origin, sink = len(out) - 2, len(out) - 1

    def arc(a: int, b: int, room: int) -> int:
        out[a].append(len(arcs))
        out[b].append(len(arcs) + 1)
        arcs.extend(([b, room], [a, 0]))
        return len(arcs) - 2

    feed = [arc(origin, p, 0) for p in range(len(capacity))]
    lines = {(p, s): arc(p, len(capacity) + s, 1 << 62) for p, m in enumerate(members) for s in m}
    for s, q in enumerate(quota):
        arc(len(capacity) + s, sink, q)
    for _ in range(repeats):
        for p, i in enumerate(feed):
            arcs[i][1] = capacity[p]
        while True:
            depth = {origin: 0}
            line = deque([origin])
            while line:
                a = line.popleft()
                for i in out[a]:
                    b, room = arcs[i]
                    # Never back through the origin: that would trade one copy for another of the same cost or more.
                    if room > 0 and b not in depth:
                        depth[b] = depth[a] + 1
                        line.append(b)
            if sink not in depth:
                break
            spot = dict.fromkeys(range(len(out)), 0)

            def push(start: int = origin, spot=spot, depth=depth) -> int:
                path, a = [], start
                while a != sink:
                    while spot[a] < len(out[a]):
                        i = out[a][spot[a]]
                        if arcs[i][1] > 0 and depth.get(arcs[i][0], -1) == depth[a] + 1:
                            break
                        spot[a] += 1
                    else:
                        if not path:
                            return 0
                        i = path.pop()
                        a = arcs[i ^ 1][0]
                        spot[a] += 1
                        continue
                    path.append(i)
                    a = arcs[i][0]
                got = min(arcs[i][1] for i in path)
                for i in path:
                    arcs[i][1] -= got
                    arcs[i ^ 1][1] += got
                return got

            while push():
                pass
        for i in feed:  # what has flowed stays; it can't be taken back into the origin
            arcs[i ^ 1][1] = 0
    return {k: arcs[i ^ 1][1] for k, i in lines.items() if arcs[i ^ 1][1]}


def first_in_order(rows: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    """wanted: (pattern, want), words. Of each pattern those rows that come first by `key` (a long below 2^48) until the want is met: pattern,
    lo1 .. lo<STEPS> (the bins the want ends in, null where all rows are taken), rest (the words left in the last of them). Earlier bins are taken whole."""
    part = wanted.select("pattern", F.lit(0).cast("long").alias("lo"), "want")
    out, names = wanted.select("pattern"), [f"lo{i}" for i in range(1, STEPS + 1)]
    for i, name in enumerate(names, 1):
        low = 48 - i * BITS
        at = rows.join(small(part), "pattern").where(F.shiftright(key, low + BITS) == F.col("lo"))
        sums = at.groupBy("pattern", "want", F.shiftright(key, low).alias("bin")).agg(F.sum("size").alias("size"))
        w = Window.partitionBy("pattern").orderBy("bin")  # at most 256 rows
        sums = sums.withColumn("before", F.sum("size").over(w) - F.col("size"))
        edge = sums.where((F.col("before") <= F.col("want")) & (F.col("before") + F.col("size") > F.col("want")))
        part = materialize(edge.select("pattern", F.col("bin").alias("lo"), (F.col("want") - F.col("before")).alias("want")), "edge")
        out = out.join(part.select("pattern", F.col("lo").alias(name)), "pattern", "left")
    return out.join(part.select("pattern", F.col("want").alias("rest")), "pattern", "left"), names


def taken_by(key: str, names: list[str], at_edge: Column) -> Column:
    """Whether a row comes before the bins' end; at_edge judges the rows of the last bin."""
    out = F
    for i, name in enumerate(names, 1):
        bin_, edge = F.shiftright(key, 48 - i * BITS), F.col(name)
        out = out.when(edge.isNull() | (bin_ < edge), True).when(bin_ > edge, False)
    return out.otherwise(F.coalesce(at_edge, F.lit(False)))


def mix(docs: DataFrame, source: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """doc_id, pattern, size, copies, taken (words, repeats counted), and the sums of each pattern.

    source: a string column or an array of strings (overlapping sources); by default the column source. Weights go to the
    sources by code point, null last, repeating."""
    spark = docs.sparkSession
    source = F.col("source") if source is None else source
    rows = docs.select(F.col(doc_id).alias("doc_id"), source.alias("src"), n_words(F.col(text)).alias("size"), F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.col(text)), F.lit(1 << 48)).alias("u"), F.monotonically_increasing_id().alias("row"))
    if rows.schema["src"].dataType.typeName() != "array":
        rows = rows.withColumn("src", F.array("src"))
    # The pattern's name: JSON of the sorted set, so that null and the empty string differ.
    rows = rows.select("doc_id", F.to_json(F.sort_array(F.array_distinct("src"), asc=False), {"ignoreNullFields": "false"}).alias("pattern"), F.array_distinct("src").alias("src"), "size", "u", "row")
    rows = materialize(rows, "sizes")
    # One row for each pattern: the driver's problem has as many nodes as there are patterns and sources, whatever the rows.
    groups = materialize(rows.groupBy("pattern").agg(F.first("src").alias("src"), F.sum("size").alias("size")), "patterns")
    if (n := groups.count()) > max_patterns:
        raise ValueError(f"{n} membership patterns; the flow is found over at most {max_patterns}")
    patterns = groups.orderBy("pattern").collect()
    names = sorted({s for p in patterns for s in p["src"]}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for p in patterns:
        for s in p["src"]:
            sizes[number[s]] += int(p["size"])
    total = sum(int(p["size"]) for p in patterns)
    goal = targets([float(x) for x in sizes], [weights[i % len(weights)] for i in range(len(names))], share * total, repeats)
    flows = flow([int(p["size"]) for p in patterns], [tuple(number[s] for s in p["src"]) for p in patterns], [round(x) for x in goal], repeats)
    plan = []
    for k, p in enumerate(patterns):
        size, own = int(p["size"]), sorted(number[s] for s in p["src"])
        amount = sum(flows.get((k, s), 0) for s in own)
        whole = min(amount // size, repeats) if size else 0
        plan.append((p["pattern"], whole, amount - whole * size if whole < repeats else 0, size, float(sum(goal[s] for s in own)), sum(sizes[s] for s in own)))
    if not plan:
        plan_df = spark.createDataFrame([], "pattern string, whole int, want long, pattern_size long, target double, source_size long")
    else:
        plan_df = spark.createDataFrame(plan, "pattern string, whole int, want long, pattern_size long, target double, source_size long")
    # Places in the order: rows equal in id and text share one.
    rows = rows.withColumn("place", F.struct("u", F.col("doc_id").isNull().alias("absent"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "size"))
    ends, names = first_in_order(rows, plan_df.where("want > 0").select("pattern", "want"), "u")
    ends = materialize(ends, "ends")
    # Places in the last bin: about one in 2^24 of a pattern's; these alone are put in order.
    last = rows.join(small(ends.where("rest is not null")), "pattern").where(F.shiftright("u", 48 - STEPS * BITS) == F.col(names[-1]))
    last = last.groupBy("pattern", "rest", "place").agg(F.count("*").alias("n"))
    w = Window.partitionBy("pattern").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("size", F.col("place.size")).withColumn("upto", F.sum(F.col("n") * F.col("size")).over(w))
    # The place that the want ends in, and how many of its rows are taken.
    left = F.col("rest") - F.col("upto") + F.col("n") * F.col("size")
    edge = last.where((left >= 0) & (F.col("upto") > F.col("rest"))).groupBy("pattern").agg(F.min(F.struct("place", F.round(left / F.col("size")).cast("long").alias("k"), "n")).alias("e"))
    edge = materialize(edge.select("pattern", F.col("e.place").alias("edge"), F.col("e.k").alias("k"), F.col("e.n").alias("n")), "edge")
    # Among several rows of one place, those that come first by their row's hash.
    some = edge.where("k > 0 and k < n")
    if some.limit(1).count():
        mine = rows.join(small(some), "pattern").where(F.col("place") == F.col("edge")).select("pattern", F.pmod(F.xxhash64("row"), F.lit(1 << 48)).alias("v"), F.lit(1).cast("long").alias("size"))
        inner, inner_names = first_in_order(mine, some.select("pattern", F.col("k").alias("want")), "v")
        ends_v = materialize(inner.select("pattern", *(F.col(x).alias(f"v{x}") for x in inner_names), F.col("rest").alias("vrest")), "ends")
        tail = mine.join(small(ends_v.where("vrest is not null")), "pattern").where(F.shiftright("v", 48 - STEPS * BITS) == F.col(f"v{inner_names[-1]}"))
        order = F.row_number().over(Window.partitionBy("pattern").orderBy("v"))
        tail = tail.withColumn("no", order).where("no <= vrest").groupBy("pattern").agg(F.max("v").alias("vedge"))
        edge = edge.join(ends_v, "pattern", "left").join(tail, "pattern", "left")
        among = taken_by("v", [f"v{x}" for x in inner_names], F.col("v") <= F.col("vedge"))
    else:
        among = F.lit(False)
    cut = small(materialize(plan_df.join(ends.drop("rest"), "pattern", "left").join(edge, "pattern", "left"), "cut"))
    out = rows.withColumn("v", F.pmod(F.xxhash64("row"), F.lit(1 << 48))).join(cut, "pattern", "left")
    at_edge = F.when(F.col("edge").isNull() | (F.col("place") < F.col("edge")), True).when(F.col("place") > F.col("edge"), False).when(F.col("k") >= F.col("n"), True).when(F.col("k") <= 0, False).otherwise(among)
    extra = F.when(F.col("want") <= 0, False).otherwise(taken_by("u", names, at_edge))
    out = out.withColumn("extra", extra)
    # One document gains or loses a copy, that whose size is nearest to what is missing or too much; none if that is no gain.
    missed = out.where("want > 0").groupBy("pattern").agg((F.first("want") - F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0))).alias("gap"))
    near = out.join(small(missed.where("gap != 0")), "pattern").where(F.when(F.col("gap") < 0, F.col("extra")).otherwise(F.col("whole") + F.col("extra").cast("int") < repeats) & (F.abs(F.abs("gap") - F.col("size")) < F.abs("gap")))
    flip = near.groupBy("pattern").agg(F.min(F.struct(F.abs(F.abs("gap") - F.col("size")).alias("off"), "place", "row"))["row"].alias("flip"), F.signum(F.first("gap")).cast("int").alias("sign"))
    out = out.join(small(flip), "pattern", "left")
    change = F.when(F.col("row") == F.col("flip"), F.col("sign")).otherwise(0)
    out = out.withColumn("copies", F.col("whole") + F.col("extra").cast("int") + change)
    return out.select("doc_id", "pattern", "src", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
