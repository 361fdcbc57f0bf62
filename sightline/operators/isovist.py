"""Plans, viewpoints and their visibility polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..scratch import if_small

OUTER = -1
#: Segments of a plan that go to every task (about 16 MB). The points of a larger plan meet them as pairs of partitions.
SEGMENTS = 200_000


def ring_edges(rings: DataFrame, key: str = "pid", order: str = "vi") -> DataFrame:
    """key, order, ax, ay, bx, by: each vertex with the next one of its ring, the last with the first."""
    w = Window.partitionBy(key).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    return rings.select(key, order, F.col("x").alias("ax"), F.col("y").alias("ay"), follow("x").alias("bx"), follow("y").alias("by"))


def ring_measures(rings: DataFrame, key: str = "pid", order: str = "vi") -> DataFrame:
    """key, n_vertices, area (0 below three vertices), perimeter (0 below two)."""
    e = ring_edges(rings, key, order)
    area = F.abs(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay"))) / 2
    n = F.count("*")
    length = F.sum(g.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    return e.groupBy(key).agg(n.alias("n_vertices"), F.when(n >= 3, area).otherwise(0.0).alias("area"), F.when(n >= 2, length).otherwise(0.0).alias("perimeter"))


def bounding_box(rings: DataFrame) -> DataFrame:
    return rings.groupBy("pid").agg(*(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y")))


def classify(rings: DataFrame, key: str = "pid") -> DataFrame:
    """key, area, role: the ring of the largest area is the outer boundary (of equal ones the first), others are obstacles."""
    m = ring_measures(rings, key).where("n_vertices >= 3")
    top = m.agg(F.max(F.struct(F.col("area"), (-F.col(key)).alias("k")))["k"].alias("k"))
    return m.join(F.broadcast(top), F.lit(True)).select(key, "area", F.when(-F.col(key) == F.col("k"), "outer").otherwise("obstacle").alias("role"))


def open_area(rings: DataFrame) -> DataFrame:
    return classify(rings).agg(F.sum(F.when(F.col("role") == "outer", F.col("area")).otherwise(-F.col("area"))).alias("open_area"))


def inside(points: DataFrame, edges: DataFrame, key: str = "pid") -> DataFrame:
    """id, key of each point in each ring (even-odd). The edges of a plan are few next to the points and go to every task (counted first)."""
    hit = g.crosses(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    at = points.join(if_small(edges, SEGMENTS), g.straddles(F.col("y"), F.col("ay"), F.col("by")) & hit)
    return at.groupBy("id", key).agg(F.count("*").alias("n")).where("n % 2 = 1").select("id", key)


def valid_points(points: DataFrame, rings: DataFrame, outer: int = OUTER) -> DataFrame:
    """Points in the outer ring and in no obstacle."""
    at = inside(points, ring_edges(rings))
    ok = at.groupBy("id").agg(F.max((F.col("pid") == outer).cast("int")).alias("o"), F.max((F.col("pid") != outer).cast("int")).alias("b")).where("o = 1 and b = 0")
    return points.join(ok.select("id"), "id", "left_semi")


def rays(centres: DataFrame, segments: DataFrame) -> DataFrame:
    """id, x, y, angle: to each end point of a segment and a little to either side, each angle once."""
    ends = segments.select(F.col("ax").alias("vx"), F.col("ay").alias("vy")).union(segments.select("bx", "by")).distinct()
    a = F.atan2(F.col("vy") - F.col("y"), F.col("vx") - F.col("x"))
    three = centres.join(if_small(ends, SEGMENTS), F.lit(True)).select("id", "x", "y", F.explode(F.array(a - g.SIDE, a, a + g.SIDE)).alias("angle"))
    return three.distinct()


def isovist_vertices(centres: DataFrame, segments: DataFrame) -> DataFrame:
    """id, vi, angle, x, y: the visibility polygon of each centre, by angle. Segments are one plan's and go to every task (counted first); a viewpoint's rays
    meet them there and the nearest hit is taken before anything is shuffled."""
    t = g.ray_hit(F.col("x"), F.col("y"), F.col("angle"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    r = rays(centres, segments)
    hits = r.join(if_small(segments, SEGMENTS), F.lit(True)).groupBy("id", "x", "y", "angle").agg(F.coalesce(F.min(t), F.lit(0.0)).alias("t"))
    w = Window.partitionBy("id").orderBy("angle")
    return hits.select("id", (F.row_number().over(w) - 1).alias("vi"), "angle", (F.col("x") + F.cos("angle") * F.col("t")).alias("x"), (F.col("y") + F.sin("angle") * F.col("t")).alias("y"))


def isovist_stats(vertices: DataFrame) -> DataFrame:
    """id, n_vertices, area, perimeter."""
    return ring_measures(vertices, "id", "vi")
