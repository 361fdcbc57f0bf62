"""The visibility graph, its components and hop counts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..scratch import numbered, written
from . import _local
from .isovist import ring_edges
from .sights import Sights
from .stars import stars


class DisconnectedGraphError(ValueError):
    """The visibility graph has more than one component."""


def visibility_edges(vertices: DataFrame, centres: DataFrame, strips: int = 256) -> DataFrame:
    """src, dst, sx, sy, dx, dy, dist in both directions: pairs whose higher-numbered centre lies in the lower one's polygon.

    Point-in-polygon by crossing counts. Polygon edges and centres meet on strips of the y axis, so a centre is
    tested only against edges that can pass its height, by an equi-join."""
    box = centres.agg(F.min("y").alias("lo"), F.max("y").alias("hi")).select("lo", F.greatest((F.col("hi") - F.col("lo")) / strips, F.lit(1e-9)).alias("h"))
    strip = lambda c: F.floor((F.greatest(F.col("lo"), F.least(F.col("lo") + F.col("h") * strips, c)) - F.col("lo")) / F.col("h"))
    e = ring_edges(vertices, "id", "vi").withColumnRenamed("id", "i").join(F.broadcast(box), F.lit(True))
    e = e.select("i", "ax", "ay", "bx", "by", F.explode(F.sequence(strip(F.least("ay", "by")), strip(F.greatest("ay", "by")))).alias("strip"))
    p = centres.join(F.broadcast(box), F.lit(True)).select("id", "x", "y", strip(F.col("y")).alias("strip"))
    hit = g.crosses(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    seen = e.join(p, "strip").where((F.col("i") < F.col("id")) & g.straddles(F.col("y"), F.col("ay"), F.col("by")) & hit)
    pairs = seen.groupBy("i", "id").agg(F.count("*").alias("n")).where("n % 2 = 1").select(F.col("i").alias("src"), F.col("id").alias("dst"))
    both = pairs.union(pairs.select("dst", "src"))
    a = centres.select(F.col("id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    b = centres.select(F.col("id").alias("dst"), F.col("x").alias("dx"), F.col("y").alias("dy"))
    out = both.join(a, "src").join(b, "dst")
    return out.select("src", "dst", "sx", "sy", "dx", "dy", g.distance(F.col("sx"), F.col("sy"), F.col("dx"), F.col("dy")).alias("dist"))


def degree(edges: DataFrame | Sights, centres: DataFrame) -> DataFrame:
    if isinstance(edges, Sights):
        return edges.each(lambda bits, at: {"id": bits.ids[at], "degree": np.bitwise_count(bits.rows[at]).sum(1, dtype=np.int64)}, "id long, degree long", centres)
    n = edges.groupBy("src").agg(F.count("*").alias("degree"))
    return centres.select("id").join(n, F.col("id") == F.col("src"), "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def components(edges: DataFrame, centres: DataFrame, arcs: int = _local.ARCS) -> DataFrame:
    """id, component: numbered from 0 by the least node of each."""
    spark, nodes = centres.sparkSession, centres.select("id")
    if isinstance(edges, Sights):
        def parts(bits, at):
            root = np.full(len(bits.ids), -1)
            for k in range(len(root)):
                if root[k] < 0:
                    root[bits.hops(k) >= 0] = k
            return {"node": bits.ids, "root": bits.ids[root]}

        root = edges.each(parts, "node long, root long", centres.orderBy("id").limit(1))
    elif (net := _local.net(edges, arcs)) is not None:
        root = spark.createDataFrame([], "node long, root long") if not len(net.ids) else spark.createDataFrame(_frame(node=net.ids, root=net.ids[net.components()]))
    else:
        root = stars(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    least = written(nodes.join(root, nodes["id"] == root["node"], "left").select("id", F.coalesce("root", "id").alias("root")))
    names = numbered(least.where("id = root").select("root"), "root", "component")
    return least.join(names, "root").select("id", "component")


def _frame(**columns: np.ndarray):
    import pyarrow as pa

    return pa.table(columns)


def component_sizes(parts: DataFrame) -> DataFrame:
    """component, size: the largest first, of equal ones the lower number."""
    return parts.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component")


def require_connected(parts: DataFrame) -> None:
    n = parts.agg(F.countDistinct("component")).first()[0]
    if n > 1:
        raise DisconnectedGraphError(f"the visibility graph has {n} components; heal it or allow islands")


DEPTHS = "anchor long, id long, depth int, paths double"


def depths(edges: DataFrame, anchors: DataFrame, arcs: int = _local.ARCS) -> DataFrame:
    """anchor, id, depth, paths: hops from each anchor to each node it reaches, and the number of shortest paths."""
    if isinstance(edges, Sights):
        def table(bits, at):
            depth, paths = bits.levels(at)
            who, got = np.nonzero(depth >= 0)
            return {"anchor": bits.ids[at[who]], "id": bits.ids[got], "depth": depth[who, got], "paths": paths[who, got]}

        return edges.each(table, DEPTHS, anchors)
    if (net := _local.net(edges, arcs)) is not None:
        def search(graph, row):
            at = graph.place(row["id"])
            if at < 0:
                yield {"anchor": row["id"], "id": [row["id"]], "depth": 0, "paths": 1.0}
                return
            depth, paths, _ = graph.levels(at)
            got = np.flatnonzero(depth >= 0)
            yield {"anchor": row["id"], "id": graph.ids[got], "depth": depth[got], "paths": paths[got]}

        return written(_local.each(anchors.select("id"), net, search, DEPTHS))
    # By levels, each a table of its own. A level's neighbours lie in it, the one before or the next (edges go both ways), so a new level is
    # held against these two only.
    e = edges.select("src", "dst")
    levels = [written(anchors.select(F.col("id").alias("anchor"), "id", F.lit(0).alias("depth"), F.lit(1.0).alias("paths")))]
    while True:
        front = levels[-1]
        near = front.unionByName(levels[-2]) if len(levels) > 1 else front
        new = front.join(e, front["id"] == e["src"]).groupBy("anchor", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        new = written(new.join(near.select("anchor", "id"), ["anchor", "id"], "left_anti").select("anchor", "id", F.lit(len(levels)).alias("depth"), "paths"))
        if new.limit(1).count() == 0:
            return _all(levels).select(*(c.split()[0] for c in DEPTHS.split(", ")))
        levels.append(new)


def hops(edges: DataFrame | Sights, anchors: DataFrame) -> DataFrame:
    """anchor, id, depth of `depths`; of a graph as bits without counting paths, which are products of matrices."""
    if not isinstance(edges, Sights):
        return depths(edges, anchors).select("anchor", "id", "depth")

    def table(bits, at):
        depth = bits.hops(at[0])
        got = np.flatnonzero(depth >= 0)
        return {"anchor": np.full(len(got), bits.ids[at[0]]), "id": bits.ids[got], "depth": depth[got]}

    return edges.each(table, "anchor long, id long, depth int", anchors, 1)


def _all(tables: list[DataFrame]) -> DataFrame:
    """Tables written one by one, read as one."""
    spark = tables[0].sparkSession
    return spark.read.schema(tables[0].schema).parquet(*sorted({f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}))


def topo_status(depth: DataFrame | Sights, centres: DataFrame) -> DataFrame:
    """id, topo_status: hops to all nodes it reaches. depth: depths, or the graph as bits, whose hops are summed where they are found."""
    if isinstance(depth, Sights):
        return depth.each(lambda bits, at: {"id": bits.ids[at], "topo_status": [int(np.maximum(bits.hops(k), 0).sum(dtype=np.int64)) for k in at]}, "id long, topo_status double", centres)
    s = depth.groupBy(F.col("anchor").alias("id")).agg(F.sum("depth").cast("double").alias("topo_status"))
    return centres.select("id").join(s, "id", "left").select("id", F.coalesce("topo_status", F.lit(0.0)).alias("topo_status"))
