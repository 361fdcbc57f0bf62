"""A plan, viewpoints and gates computed from the driver's tables by plain double arithmetic, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import isovist

#: Steps of the two-dimensional low-discrepancy sequence.
STEP_X, STEP_Y = 0.7548776662466927, 0.5698402909980532


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(offset: float, k: Column, step: float) -> Column:
    z = F.lit(offset) + k * F.lit(step)
    return F.lit(100.0) * (z - F.floor(z))


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, vi, x, y: the outer square (pid -1) and one diamond for each nation."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    n = n.select("k", (10.0 + 20.0 * (F.col("k") % 5)).alias("cx"), (10.0 + 20.0 * F.floor(F.col("k") / 5)).alias("cy"), (4.0 + 0.6 * (F.col("k") * 7 % 5)).alias("hx"), (4.0 + 0.7 * (F.col("k") * 3 % 5)).alias("hy"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    cx, cy, hx, hy = (F.col(c) for c in ("cx", "cy", "hx", "hy"))
    four = n.select(F.col("k").alias("pid"), F.posexplode(F.array(point(cx - hx, cy), point(cx, cy - hy), point(cx + hx, cy), point(cx, cy + hy))).alias("vi", "p"))
    outer = spark.range(1).select(F.lit(-1).cast("long").alias("pid"), F.posexplode(F.array(*(point(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0))))).alias("vi", "p"))
    return four.unionByName(outer).select("pid", "vi", "p.x", "p.y")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("long")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), spread(0.5, k, STEP_X).alias("x"), spread(0.5, k, STEP_Y).alias("y"))


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isovist.valid_points(candidates(spark, sf_dir), rings(spark, sf_dir))


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("long")
    return table(spark, sf_dir, "customer").select(k.alias("gate_idx"), F.col("c_name").alias("label"), spread(0.25, k, STEP_X).alias("x"), spread(0.75, k, STEP_Y).alias("y"), F.col("c_acctbal").alias("count"))


#: The same in SQL, as common table expressions up to the visibility edges.
SQL = f"""
nat AS (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation),
dia AS (SELECT k, 10.0::DOUBLE + 20.0::DOUBLE * (k % 5) AS cx, 10.0::DOUBLE + 20.0::DOUBLE * floor(k / 5) AS cy, 4.0::DOUBLE + 0.6::DOUBLE * (k * 7 % 5) AS hx, 4.0::DOUBLE + 0.7::DOUBLE * (k * 3 % 5) AS hy FROM nat),
rings AS (SELECT k AS pid, 0 AS vi, cx - hx AS x, cy AS y FROM dia UNION ALL SELECT k, 1, cx, cy - hy FROM dia UNION ALL SELECT k, 2, cx + hx, cy FROM dia UNION ALL SELECT k, 3, cx, cy + hy FROM dia
  UNION ALL SELECT * FROM (VALUES (-1::BIGINT, 0, 0.0::DOUBLE, 0.0::DOUBLE), (-1, 1, 100.0, 0.0), (-1, 2, 100.0, 100.0), (-1, 3, 0.0, 100.0)) v(pid, vi, x, y)),
segments AS (SELECT pid, vi, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS by_ FROM rings WINDOW w AS (PARTITION BY pid ORDER BY vi)),
cand0 AS (SELECT CAST(s_suppkey AS BIGINT) AS id, 0.5::DOUBLE + CAST(s_suppkey AS BIGINT) * {STEP_X}::DOUBLE AS zx, 0.5::DOUBLE + CAST(s_suppkey AS BIGINT) * {STEP_Y}::DOUBLE AS zy FROM supplier),
cand AS (SELECT id, 100.0::DOUBLE * (zx - floor(zx)) AS x, 100.0::DOUBLE * (zy - floor(zy)) AS y FROM cand0),
ins AS (SELECT id, pid FROM cand, segments WHERE (by_ > y) <> (ay > y) AND x < (ax - bx) * (y - by_) / (CASE WHEN ay = by_ THEN 1.0 ELSE ay - by_ END) + bx GROUP BY id, pid HAVING count(*) % 2 = 1),
centres AS (SELECT id, x, y FROM cand WHERE id IN (SELECT id FROM ins WHERE pid = -1) AND id NOT IN (SELECT id FROM ins WHERE pid <> -1)),
"""
ISOVIST = """
ends AS (SELECT DISTINCT x AS vx, y AS vy FROM rings),
ang AS (SELECT DISTINCT id, x, y, unnest([atan2(vy - y, vx - x) - 1e-6, atan2(vy - y, vx - x), atan2(vy - y, vx - x) + 1e-6]) AS a FROM centres, ends),
cs AS (SELECT *, cos(a) AS c, sin(a) AS s FROM ang),
hit AS (SELECT id, cs.x, cs.y, a, c, s, (bx - ax) * s - (by_ - ay) * c AS den, (bx - ax) * (ay - y) - (by_ - ay) * (ax - x) AS nt, c * (ay - y) - s * (ax - x) AS nu FROM cs, segments),
best AS (SELECT id, x, y, a, c, s, min(CASE WHEN abs(den) >= 1e-12 THEN CASE WHEN nt / den >= 1e-9 AND nu / den >= -1e-9 AND nu / den <= 1.0 + 1e-9 THEN nt / den END END) AS t FROM hit GROUP BY ALL),
iso AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY a) - 1 AS vi, x + c * coalesce(t, 0.0) AS x, y + s * coalesce(t, 0.0) AS y FROM best),
isoe AS (SELECT id, vi, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS by_ FROM iso WINDOW w AS (PARTITION BY id ORDER BY vi)),
"""
EDGES = """
prs AS (SELECT e.id AS i, p.id AS j FROM isoe e JOIN centres p ON e.id < p.id AND (e.by_ > p.y) <> (e.ay > p.y) AND p.x < (e.ax - e.bx) * (p.y - e.by_) / (CASE WHEN e.ay = e.by_ THEN 1.0 ELSE e.ay - e.by_ END) + e.bx GROUP BY 1, 2 HAVING count(*) % 2 = 1),
sym AS (SELECT i AS src, j AS dst FROM prs UNION ALL SELECT j, i FROM prs),
edges AS MATERIALIZED (SELECT src, dst, a.x AS sx, a.y AS sy, b.x AS dx, b.y AS dy, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS dist FROM sym JOIN centres a ON a.id = src JOIN centres b ON b.id = dst),
"""
