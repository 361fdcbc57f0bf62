"""The queries of the spatial operators and their SQL, over the fixture that plans/fixture.py derives from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import centrality, gates, graph, heatmap, isovist, metrics, place, routes, sights
from .operators._loop import written
from .plans import fixture
from .sources import svgpath

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def r4(*names: str) -> list:
    return [F.round(F.col(n), 4).alias(n) for n in names]


def _world(spark: SparkSession, sf_dir: str, edges: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    c = written(fixture.centres(spark, sf_dir))
    v = isovist.isovist_vertices(c, isovist.ring_edges(fixture.rings(spark, sf_dir)))
    return c, v, written(graph.visibility_edges(v, c)) if edges else None


def _seen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, sights.Sights | DataFrame]:
    """Centres and their graph, as bits where they are few enough."""
    c = written(fixture.centres(spark, sf_dir))
    plan = isovist.ring_edges(fixture.rings(spark, sf_dir))
    if (e := sights.sights(c, plan)) is None:
        e = written(graph.visibility_edges(isovist.isovist_vertices(c, plan), c))
    return c, e


def _choices(c: DataFrame, e: sights.Sights | DataFrame) -> DataFrame:
    if isinstance(e, sights.Sights):
        return centrality.choices(e)
    delta = centrality.dependencies(e, graph.depths(e, c))
    return centrality.choice(delta).join(centrality.d_choice(delta, e), "id")


def _pair(c: DataFrame) -> DataFrame:
    return c.agg(F.min("id").alias("origin"), F.max("id").alias("dest"))


BASE, FULL = f"WITH {fixture.SQL}", f"WITH RECURSIVE {fixture.SQL}{fixture.ISOVIST}{fixture.EDGES}"
DUMMY = "z AS (SELECT 1)"


@query(f"{BASE}{DUMMY} SELECT pid, count(*) AS n_vertices, round(abs(sum(ax * by_ - bx * ay)) / 2, 4) AS area, round(sum(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))), 4) AS perimeter FROM segments GROUP BY pid")
def ring_measures(spark, sf_dir):
    return isovist.ring_measures(fixture.rings(spark, sf_dir)).select("pid", "n_vertices", *r4("area", "perimeter"))


@query(f"{BASE}a AS (SELECT pid, abs(sum(ax * by_ - bx * ay)) / 2 AS area FROM segments GROUP BY pid) SELECT pid, round(area, 4) AS area, CASE WHEN row_number() OVER (ORDER BY area DESC, pid) = 1 THEN 'outer' ELSE 'obstacle' END AS role FROM a")
def outer_boundary(spark, sf_dir):
    return isovist.classify(fixture.rings(spark, sf_dir)).select("pid", *r4("area"), "role")


@query(f"{BASE}a AS (SELECT pid, abs(sum(ax * by_ - bx * ay)) / 2 AS area FROM segments GROUP BY pid) SELECT (SELECT round(sum(CASE WHEN pid = -1 THEN area ELSE -area END), 4) FROM a) AS open_area, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM rings WHERE pid = -1")
def plan_area_bbox(spark, sf_dir):
    r = fixture.rings(spark, sf_dir)
    box = isovist.bounding_box(r.where("pid = -1")).drop("pid")
    return isovist.open_area(r).select(*r4("open_area")).join(F.broadcast(box), F.lit(True))


@query(f"{BASE}{DUMMY} SELECT id, round(x, 4) AS x, round(y, 4) AS y FROM centres")
def valid_centers(spark, sf_dir):
    return fixture.centres(spark, sf_dir).select("id", *r4("x", "y"))


@query(f"{BASE}{DUMMY} SELECT pid, vi, round(ax, 4) AS ax, round(ay, 4) AS ay, round(bx, 4) AS bx, round(by_, 4) AS by_ FROM segments")
def segments(spark, sf_dir):
    return isovist.ring_edges(fixture.rings(spark, sf_dir)).withColumnRenamed("by", "by_").select("pid", "vi", *r4("ax", "ay", "bx", "by_"))


@query(f"{BASE}{fixture.ISOVIST}{DUMMY} SELECT id, round(abs(sum(ax * by_ - bx * ay)) / 2, 4) AS area, round(sum(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))), 4) AS perimeter FROM isoe GROUP BY id")
def isovist_polygon_stats(spark, sf_dir):
    _, v, _ = _world(spark, sf_dir, False)
    return isovist.isovist_stats(v).select("id", *r4("area", "perimeter"))


@query(f"{BASE}{fixture.ISOVIST}{DUMMY} SELECT id, vi, round(x, 4) AS x, round(y, 4) AS y FROM iso")
def isovist_vertices(spark, sf_dir):
    _, v, _ = _world(spark, sf_dir, False)
    return v.select("id", F.col("vi").cast("long").alias("vi"), *r4("x", "y"))


@query(f"{FULL}{DUMMY} SELECT src, dst, round(dist, 4) AS dist FROM edges")
def visibility_edges(spark, sf_dir):
    return _world(spark, sf_dir)[2].select("src", "dst", *r4("dist"))


@query(f"{FULL}{DUMMY} SELECT id, (SELECT count(*) FROM edges WHERE src = id) AS degree FROM centres")
def degree(spark, sf_dir):
    c, _, e = _world(spark, sf_dir)
    return graph.degree(e, c)


@query(f"{FULL}{DUMMY} SELECT (SELECT count(*) FROM centres) AS nodes, (SELECT count(*) FROM edges) // 2 AS edges")
def edge_count(spark, sf_dir):
    c, _, e = _world(spark, sf_dir)
    return c.agg(F.count("*").alias("nodes")).join(e.where("src < dst").agg(F.count("*").alias("edges")), F.lit(True))


REACH = "reach(a, id) AS (SELECT id, id FROM centres UNION SELECT a, dst FROM reach JOIN edges ON src = reach.id), root AS (SELECT id, min(a) AS r FROM reach GROUP BY id), comp AS (SELECT id, dense_rank() OVER (ORDER BY r) - 1 AS component FROM root)"


@query(f"{FULL}{REACH} SELECT id, component FROM comp")
def components(spark, sf_dir):
    c, _, e = _world(spark, sf_dir)
    return graph.components(e, c)


@query(f"{FULL}{REACH} SELECT component, count(*) AS size FROM comp GROUP BY component")
def component_sizes(spark, sf_dir):
    c, _, e = _world(spark, sf_dir)
    return graph.component_sizes(graph.components(e, c))


HOPS = "hops(a, id, d) USING KEY (a, id) AS (SELECT id, id, 0 FROM centres UNION SELECT h.a, e.dst, min(h.d + 1) FROM hops h JOIN edges e ON e.src = h.id LEFT JOIN recurring.hops o ON o.a = h.a AND o.id = e.dst WHERE o.d IS NULL OR h.d + 1 < o.d GROUP BY h.a, e.dst)"


@query(f"{FULL}{HOPS} SELECT a AS anchor, id, d AS depth FROM hops")
def topo_depth(spark, sf_dir):
    c, e = _seen(spark, sf_dir)
    return graph.hops(e, c)


@query(f"{FULL}{HOPS} SELECT a AS id, CAST(sum(d) AS DOUBLE) AS topo_status FROM hops GROUP BY a")
def topo_status(spark, sf_dir):
    c, e = _seen(spark, sf_dir)
    return graph.topo_status(e if isinstance(e, sights.Sights) else graph.depths(e, c), c)


# Shortest-path counts by level; the dependency of s on v is the sum over t of paths through v by all paths.
PATHS = f"{HOPS}, lv AS MATERIALIZED (SELECT * FROM hops), cnt(a, id, d, n) AS (SELECT id, id, 0, 1.0::DOUBLE FROM centres UNION ALL (SELECT c.a, e.dst, c.d + 1, sum(c.n) FROM cnt c JOIN edges e ON e.src = c.id JOIN lv ON lv.a = c.a AND lv.id = e.dst AND lv.d = c.d + 1 GROUP BY c.a, e.dst, c.d)), sg AS MATERIALIZED (SELECT * FROM cnt), dl AS MATERIALIZED (SELECT p.a, p.id, sum(p.n * q.n / t.n) AS delta FROM sg p JOIN sg q ON q.a = p.id AND q.d > 0 JOIN sg t ON t.a = p.a AND t.id = q.id AND t.d = p.d + q.d GROUP BY p.a, p.id), ch AS (SELECT c.id, coalesce(sum(delta), 0) AS choice FROM centres c LEFT JOIN dl ON dl.id = c.id AND dl.a <> c.id GROUP BY c.id)"


@query(f"{FULL}{PATHS} SELECT id, round(choice, 4) AS choice FROM ch")
def choice(spark, sf_dir):
    c, e = _seen(spark, sf_dir)
    return _choices(c, e).select("id", *r4("choice"))


@query(f"{FULL}{PATHS} SELECT c.id, round(coalesce(sum(choice - coalesce(delta, 0)), 0), 4) AS d_choice FROM centres c LEFT JOIN edges e ON e.src = c.id LEFT JOIN ch ON ch.id = e.dst LEFT JOIN dl ON dl.a = c.id AND dl.id = e.dst GROUP BY c.id")
def d_choice(spark, sf_dir):
    c, e = _seen(spark, sf_dir)
    return _choices(c, e).select("id", *r4("d_choice"))


def _angle(ax, ay, bx, by):
    """SQL of the angle between two vectors."""
    return f"(CASE WHEN sqrt(({ax})*({ax})+({ay})*({ay})) < 1e-12 OR sqrt(({bx})*({bx})+({by})*({by})) < 1e-12 THEN 0.0 ELSE acos(greatest(-1.0, least(1.0, (({ax})*({bx})+({ay})*({by})) / (sqrt(({ax})*({ax})+({ay})*({ay})) * sqrt(({bx})*({bx})+({by})*({by})))))) END)"


UNITS = f"({_angle('g.x - e.sx', 'g.y - e.sy', 'e.dx - e.sx', 'e.dy - e.sy')} * (180.0 / pi()) / 90.0)"


def _route_sql(cost: str, extra: str = "", rule: str = "TRUE", gammas: str = "[1.0]", gamma: str = "") -> str:
    """gamma: the column that names the exponent, if the result has it."""
    hops = "" if "lv AS" in extra else f"{HOPS}, lv AS MATERIALIZED (SELECT * FROM hops), "
    return f"""{FULL}{extra}{hops}od AS (SELECT min(id) AS o, max(id) AS d FROM centres), gm AS (SELECT unnest({gammas})::DOUBLE AS gamma),
w AS MATERIALIZED (SELECT gamma, e.src, e.dst, {cost} AS w FROM edges e, gm, od JOIN centres g ON g.id = od.d WHERE {rule}),
st(gamma, id, c, p) USING KEY (gamma, id) AS (SELECT gamma, o, 0.0::DOUBLE, CAST(o AS VARCHAR) FROM od, gm UNION SELECT w.gamma, w.dst, min(s.c + w.w), arg_min(s.p || '-' || w.dst, s.c + w.w) FROM st s JOIN w ON w.src = s.id AND w.gamma = s.gamma LEFT JOIN recurring.st x ON x.id = w.dst AND x.gamma = w.gamma WHERE x.c IS NULL OR s.c + w.w < x.c GROUP BY w.gamma, w.dst),
rt AS (SELECT st.gamma, o, d, p, c, string_split(p, '-') AS l FROM od JOIN st ON st.id = od.d),
sp AS (SELECT gamma, l, unnest(range(1, len(l) + 1)) AS i FROM rt),
co AS (SELECT sp.gamma, string_agg(printf('%.4f', w.w), ',' ORDER BY i) AS edge_costs FROM sp JOIN w ON w.gamma = sp.gamma AND w.src = CAST(l[i] AS BIGINT) AND w.dst = CAST(l[i + 1] AS BIGINT) GROUP BY sp.gamma),
dp AS (SELECT gamma, string_agg(CAST(lv.d AS VARCHAR), ',' ORDER BY i) AS topo_depths FROM sp, od JOIN lv ON lv.a = od.d AND lv.id = CAST(l[i] AS BIGINT) GROUP BY gamma)
SELECT {gamma}o AS origin, d AS dest, p AS path, coalesce(edge_costs, '') AS edge_costs, topo_depths, round(c, 4) AS total FROM rt LEFT JOIN co USING (gamma) LEFT JOIN dp USING (gamma)"""


def _route_row(df: DataFrame, *more: str) -> DataFrame:
    costs = F.array_join(F.transform("edge_costs", lambda x: F.format_string("%.4f", x)), ",")
    return df.select(*more, "origin", "dest", F.array_join("path", "-").alias("path"), costs.alias("edge_costs"), F.array_join("topo_depths", ",").alias("topo_depths"), F.round("total", 4).alias("total"))


@query(_route_sql("e.dist"))
def metric_route(spark, sf_dir):
    c, e = _seen(spark, sf_dir)
    return _route_row(routes.metric_route(_pair(c), c, e))


@query(_route_sql(f"pow({UNITS}, 1.0) * e.dist"))
def polar_route(spark, sf_dir):
    c, e = _seen(spark, sf_dir)
    return _route_row(routes.polar_route(_pair(c), c, e))


@query(_route_sql(UNITS, f"{HOPS}, lv AS MATERIALIZED (SELECT * FROM hops), ", "(SELECT d FROM lv WHERE a = od.d AND id = e.dst) <= (SELECT d FROM lv WHERE a = od.d AND id = e.src)"))
def nose_route(spark, sf_dir):
    c, e = _seen(spark, sf_dir)
    return _route_row(routes.nose_route(_pair(c), c, e))


@query(f"""{FULL}{HOPS}, lv AS MATERIALIZED (SELECT * FROM hops), od AS (SELECT min(id) AS o, max(id) AS d FROM centres),
wk(id, p, k) AS (SELECT o, CAST(o AS VARCHAR), 0 FROM od UNION ALL SELECT n.dst, wk.p || '-' || n.dst, wk.k + 1 FROM wk, od, LATERAL (SELECT min(e.dst) AS dst FROM edges e JOIN lv a ON a.a = od.d AND a.id = e.dst JOIN lv b ON b.a = od.d AND b.id = e.src WHERE e.src = wk.id AND a.d = b.d - 1) n WHERE n.dst IS NOT NULL)
SELECT o AS origin, od.d AS dest, p AS path, array_to_string(['1.0000' for x in range(k)], ',') AS edge_costs, array_to_string(range(k, -1, -1), ',') AS topo_depths, CAST(k AS DOUBLE) AS total FROM od JOIN wk ON wk.id = od.d""")
def topo_route(spark, sf_dir):
    c, _, e = _world(spark, sf_dir)
    return _route_row(routes.topo_route(_pair(c), c, e))


#: A grid of the nations' keys, numbered out of order, so that most routes have ties.
GRID = "grid AS (SELECT CAST((n_nationkey * 7) % 25 AS BIGINT) AS id, CAST(n_nationkey % 5 AS DOUBLE) AS x, CAST(n_nationkey // 5 AS DOUBLE) AS y FROM nation), ge AS (SELECT a.id AS src, b.id AS dst FROM grid a JOIN grid b ON abs(a.x - b.x) + abs(a.y - b.y) = 1)"


@query(f"""WITH RECURSIVE {GRID}, gh AS (SELECT a.id AS a, b.id AS id, CAST(abs(a.x - b.x) + abs(a.y - b.y) AS INT) AS d FROM grid a, grid b),
gw(o, t, id, p) AS (SELECT a.id, b.id, a.id, CAST(a.id AS VARCHAR) FROM grid a, grid b UNION ALL SELECT w.o, w.t, n.dst, w.p || '-' || n.dst FROM gw w, LATERAL (SELECT min(e.dst) AS dst FROM ge e JOIN gh x ON x.a = w.t AND x.id = e.dst JOIN gh y ON y.a = w.t AND y.id = w.id WHERE e.src = w.id AND x.d = y.d - 1) n WHERE n.dst IS NOT NULL)
SELECT o AS origin, t AS dest, p AS path FROM gw WHERE id = t""")
def topo_route_grid(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    c = written(fixture.table(spark, sf_dir, "nation").select((k * 7 % 25).alias("id"), (k % 5).cast("double").alias("x"), F.floor(k / 5).cast("double").alias("y")))
    a, b = (c.select(F.col("id").alias(n), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y")) for n, p in (("src", "s"), ("dst", "d")))
    # Neighbours on the grid, by their places.
    near = a.withColumn("step", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0))))))
    e = near.join(b, (F.col("sx") + F.col("step.i") == F.col("dx")) & (F.col("sy") + F.col("step.j") == F.col("dy"))).select("src", "dst", "sx", "sy", "dx", "dy", F.lit(1.0).alias("dist"))
    pairs = c.select(F.col("id").alias("origin")).join(F.broadcast(c.select(F.col("id").alias("dest"))), F.lit(True))
    return routes.topo_route(pairs, c, written(e)).select("origin", "dest", F.array_join("path", "-").alias("path"))


WAYS = f"ways AS MATERIALIZED (SELECT e.src AS a, e.dst AS b, f.dst AS c, CASE WHEN sqrt((f.dx-f.sx)*(f.dx-f.sx)+(f.dy-f.sy)*(f.dy-f.sy)) < 1e-12 OR e.dist < 1e-12 THEN 0.0 ELSE pi() - {_angle('f.dx - f.sx', 'f.dy - f.sy', 'e.sx - f.sx', 'e.sy - f.sy')} END AS turn, {_angle('e.dx - e.sx', 'e.dy - e.sy', 'f.dx - f.sx', 'f.dy - f.sy')} AS heading, f.sx, f.sy, f.dx, f.dy FROM edges e JOIN edges f ON f.src = e.dst AND f.dst <> e.src), "
ARCS = f"{WAYS}ar(a, cur, prev, c) USING KEY (a, cur, prev) AS (SELECT src, dst, src, 0.0::DOUBLE FROM edges UNION SELECT s.a, w.c, w.b, min(s.c + w.turn) FROM ar s JOIN ways w ON w.a = s.prev AND w.b = s.cur LEFT JOIN recurring.ar x ON x.a = s.a AND x.cur = w.c AND x.prev = w.b WHERE x.c IS NULL OR s.c + w.turn < x.c GROUP BY s.a, w.c, w.b)"


@query(f"{FULL}{ARCS} SELECT c.id, round(coalesce(sum(v), 0) * (180.0 / pi()), 4) AS angular_integration FROM centres c LEFT JOIN (SELECT a, cur, min(c) AS v FROM ar WHERE cur <> a GROUP BY a, cur) ON a = c.id GROUP BY c.id")
def angular_integration(spark, sf_dir):
    c, e = _seen(spark, sf_dir)
    return centrality.angular_integration(e if isinstance(e, sights.Sights) else centrality.arc_costs(e), c).select("id", *r4("angular_integration"))


OD = "od AS (SELECT min(id) AS o, max(id) AS d FROM centres)"


def _over_sql(first: str, step: str, name: str) -> str:
    return f"""{FULL}{WAYS}{OD}, {name}(cur, prev, c, p) USING KEY (cur, prev) AS (SELECT e.dst, e.src, {first}, e.src || '-' || e.dst FROM edges e, od JOIN centres g ON g.id = od.d WHERE e.src = o
 UNION SELECT w.c, w.b, min(s.c + {step}), arg_min(s.p || '-' || w.c, s.c + {step}) FROM {name} s, od JOIN centres g ON g.id = od.d JOIN ways w ON w.a = s.prev AND w.b = s.cur LEFT JOIN recurring.{name} x ON x.cur = w.c AND x.prev = w.b WHERE s.cur <> od.d AND (x.c IS NULL OR s.c + {step} < x.c) GROUP BY w.c, w.b)"""


@query(f"{_over_sql('0.0::DOUBLE', 'w.turn', 'ag')} SELECT o AS origin, d AS dest, arg_min(p, (c, prev)) AS path, round(min(c), 4) AS total FROM od JOIN ag ON ag.cur = d GROUP BY o, d")
def angular_route(spark, sf_dir):
    c, e = _seen(spark, sf_dir)
    return _route_row(routes.angular_route(_pair(c), c, e)).drop("edge_costs", "topo_depths")


GOAL_W = _angle("w.dx - w.sx", "w.dy - w.sy", "g.x - w.sx", "g.y - w.sy")
GOAL_E = _angle("e.dx - e.sx", "e.dy - e.sy", "g.x - e.sx", "g.y - e.sy")
PROSPECT = f"{WAYS}pr(goal, u, v, c) USING KEY (goal, u, v) AS (SELECT dst, src, dst, 0.0::DOUBLE FROM edges UNION SELECT s.goal, w.a, w.b, min(s.c + {GOAL_W} + w.heading) FROM pr s JOIN ways w ON w.b = s.u AND w.c = s.v JOIN centres g ON g.id = s.goal LEFT JOIN recurring.pr x ON x.goal = s.goal AND x.u = w.a AND x.v = w.b WHERE x.c IS NULL OR s.c + {GOAL_W} + w.heading < x.c GROUP BY s.goal, w.a, w.b), po AS (SELECT s.goal, s.u, min(s.c + {GOAL_E}) * (180.0 / pi()) AS c FROM pr s JOIN edges e ON e.src = s.u AND e.dst = s.v JOIN centres g ON g.id = s.goal WHERE s.u <> s.goal GROUP BY s.goal, s.u)"


@query(f"{FULL}{PROSPECT} SELECT c.id, round(coalesce(sum(c), 0), 4) AS prospect_status FROM centres c LEFT JOIN po ON goal = c.id GROUP BY c.id")
def prospect_status(spark, sf_dir):
    c, e = _seen(spark, sf_dir)
    return centrality.prospect_status(e, c).select("id", *r4("prospect_status"))


@query(f"{_over_sql(GOAL_E, f'({GOAL_W} + w.heading)', 'pf')} SELECT o AS origin, d AS dest, arg_min(p, (c, prev)) AS path, round(min(c) * (180.0 / pi()), 4) AS total FROM od JOIN pf ON pf.cur = d GROUP BY o, d")
def prospect_route(spark, sf_dir):
    c, e = _seen(spark, sf_dir)
    return _route_row(routes.prospect_route(_pair(c), c, e)).drop("edge_costs", "topo_depths")


#: Paths are followed back along the parents that made an arc's cost; each node between the ends gives 1 to its neighbours.
BETWEEN = """wq AS MATERIALIZED (SELECT a, b, c, round(turn * 1e9) AS turn FROM ways),
aq(a, cur, prev, c) USING KEY (a, cur, prev) AS (SELECT src, dst, src, 0.0::DOUBLE FROM edges UNION SELECT s.a, w.c, w.b, min(s.c + w.turn) FROM aq s JOIN wq w ON w.a = s.prev AND w.b = s.cur LEFT JOIN recurring.aq x ON x.a = s.a AND x.cur = w.c AND x.prev = w.b WHERE x.c IS NULL OR s.c + w.turn < x.c GROUP BY s.a, w.c, w.b),
aa AS MATERIALIZED (SELECT * FROM aq),
pa AS MATERIALIZED (SELECT q.a, q.cur, q.prev, min(w.a) AS parent FROM aa q JOIN wq w ON w.b = q.prev AND w.c = q.cur JOIN aa x ON x.a = q.a AND x.cur = w.b AND x.prev = w.a WHERE q.prev <> q.a AND x.c + w.turn = q.c GROUP BY q.a, q.cur, q.prev),
be AS (SELECT a, cur, arg_min(prev, (c, prev)) AS prev FROM aa WHERE cur <> a GROUP BY a, cur),
wb(a, e, cur, prev) AS (SELECT a, cur, cur, prev FROM be UNION ALL SELECT wb.a, wb.e, wb.prev, pa.parent FROM wb JOIN pa ON pa.a = wb.a AND pa.cur = wb.cur AND pa.prev = wb.prev),
md AS (SELECT cur, CAST(count(*) AS DOUBLE) AS n FROM wb WHERE cur <> e GROUP BY cur),
ac AS (SELECT c.id, coalesce(sum(n), 0.0) AS a_choice FROM centres c LEFT JOIN edges e ON e.src = c.id LEFT JOIN md ON md.cur = e.dst GROUP BY c.id)"""


@query(f"{FULL}{WAYS}{BETWEEN} SELECT id, a_choice FROM ac")
def a_choice(spark, sf_dir):
    c, e = _seen(spark, sf_dir)
    return centrality.a_choice(e if isinstance(e, sights.Sights) else centrality.arc_costs(e, whole=centrality.WHOLE), e, c)


def _polar_sql(gammas: str) -> str:
    return f"""{FULL}gm AS (SELECT unnest({gammas})::DOUBLE AS gamma),
pl(gamma, goal, id, c, ang) USING KEY (gamma, goal, id) AS (SELECT gamma, id, id, 0.0::DOUBLE, 0.0::DOUBLE FROM centres, gm
 UNION SELECT s.gamma, s.goal, e.src, min(s.c + pow({UNITS}, s.gamma) * e.dist), arg_min(s.ang + {UNITS}, s.c + pow({UNITS}, s.gamma) * e.dist) FROM pl s JOIN edges e ON e.dst = s.id JOIN centres g ON g.id = s.goal LEFT JOIN recurring.pl x ON x.gamma = s.gamma AND x.goal = s.goal AND x.id = e.src WHERE x.c IS NULL OR s.c + pow({UNITS}, s.gamma) * e.dist < x.c GROUP BY s.gamma, s.goal, e.src)
SELECT gamma, goal AS id, round(sum(ang), 4) AS polar_status_angle, round(sum(c), 4) AS polar_status_product FROM pl GROUP BY gamma, goal"""


@query(_polar_sql("[1.0]"))
def polar_status(spark, sf_dir):
    c, e = _seen(spark, sf_dir)
    return centrality.polar_status(e, c).select("gamma", "id", *r4("polar_status_angle", "polar_status_product"))


#: 1.00 to 6.00 in steps of 0.20.
GAMMAS = [round(1.0 + 0.2 * i, 1) for i in range(26)]


@query(_polar_sql(str(GAMMAS)))
def polar_gamma_sweep(spark, sf_dir):
    c, e = _seen(spark, sf_dir)
    return centrality.polar_status(e, c, GAMMAS).select("gamma", "id", *r4("polar_status_angle", "polar_status_product"))


@query(_route_sql(f"pow({UNITS}, gamma) * e.dist", gammas=str(GAMMAS), gamma="gamma, "))
def polar_route_sweep(spark, sf_dir):
    c, e = _seen(spark, sf_dir)
    return _route_row(routes.polar_sweep(_pair(c), c, e, GAMMAS), "gamma")


GATES = f"gate0 AS (SELECT CAST(c_custkey AS BIGINT) AS gate_idx, c_name AS label, c_acctbal AS count, 0.25::DOUBLE + CAST(c_custkey AS BIGINT) * {fixture.STEP_X}::DOUBLE AS zx, 0.75::DOUBLE + CAST(c_custkey AS BIGINT) * {fixture.STEP_Y}::DOUBLE AS zy FROM customer), gates AS (SELECT gate_idx, label, count, 100.0::DOUBLE * (zx - floor(zx)) AS x, 100.0::DOUBLE * (zy - floor(zy)) AS y FROM gate0), near AS (SELECT gate_idx, c.id, sqrt((c.x - g.x) * (c.x - g.x) + (c.y - g.y) * (c.y - g.y)) AS d FROM gates g, centres c), mt AS (SELECT gate_idx, arg_min(id, (d, -id)) AS isovist_id FROM near WHERE d <= 5.0 GROUP BY gate_idx)"


@query(f"{BASE}{GATES} SELECT gate_idx, label, round(x, 4) AS x, round(y, 4) AS y, isovist_id FROM gates LEFT JOIN mt USING (gate_idx)")
def gate_match(spark, sf_dir):
    c = fixture.centres(spark, sf_dir)
    return gates.match(fixture.gates(spark, sf_dir), c, 5.0).select("gate_idx", "label", *r4("x", "y"), "isovist_id")


@query(f"{FULL}{GATES}, ar AS (SELECT id, abs(sum(ax * by_ - bx * ay)) / 2 AS area FROM isoe GROUP BY id), dg AS (SELECT src, count(*) AS n FROM edges GROUP BY src) SELECT gate_idx, label, count, round(CASE WHEN count > 0 THEN ln(CASE WHEN count > 0 THEN count ELSE 1 END) END, 4) AS log_count, isovist_id, round(c.x, 4) AS isovist_x, round(c.y, 4) AS isovist_y, round(area, 4) AS area, CASE WHEN isovist_id IS NOT NULL THEN coalesce(n, 0) END AS degree FROM gates LEFT JOIN mt USING (gate_idx) LEFT JOIN centres c ON c.id = isovist_id LEFT JOIN ar ON ar.id = isovist_id LEFT JOIN dg ON dg.src = isovist_id")
def gate_report(spark, sf_dir):
    c, v, e = _world(spark, sf_dir)
    m = metrics.metrics(c, v, e, only={"area", "degree"})
    return gates.report(gates.match(fixture.gates(spark, sf_dir), c, 5.0), c, m).select("gate_idx", "label", "count", *r4("log_count"), "isovist_id", *r4("isovist_x", "isovist_y", "area"), "degree")


AREA = "ar AS (SELECT id, abs(sum(ax * by_ - bx * ay)) / 2 AS v FROM isoe GROUP BY id), t AS (SELECT id, v, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) AS t FROM ({}))"
HEAT = "h AS (SELECT id, v, 4.0 * {t} AS h FROM t), p AS (SELECT id, v, h, 0.9 * (1 - abs(h - 2 * floor(h / 2) - 1)) AS x FROM h), q AS (SELECT id, v, CASE floor(h) WHEN 0 THEN 0.9 WHEN 1 THEN x ELSE 0.0 END AS r, CASE floor(h) WHEN 0 THEN x WHEN 1 THEN 0.9 WHEN 2 THEN 0.9 WHEN 3 THEN x ELSE 0.0 END AS g, CASE floor(h) WHEN 2 THEN x WHEN 3 THEN 0.9 WHEN 4 THEN 0.9 ELSE 0.0 END AS b FROM p) SELECT id, round(v, 4) AS value, printf('#%02x%02x%02x', CAST(round(r * 255) AS INT), CAST(round(g * 255) AS INT), CAST(round(b * 255) AS INT)) AS color FROM q"


@query(f"{BASE}{fixture.ISOVIST}{AREA.format('SELECT * FROM ar')}, {HEAT.format(t='t')}")
def heatmap_area(spark, sf_dir):
    c, v, _ = _world(spark, sf_dir, False)
    m = c.join(isovist.isovist_stats(v).select("id", "area"), "id")
    return heatmap.heatmap(m, "area").select("id", *r4("value"), "color")


@query(f"{BASE}{fixture.ISOVIST}{AREA.format('SELECT id, ln(v + 1) AS v FROM ar')}, {HEAT.format(t='(1 - t)')}")
def heatmap_area_log_flip(spark, sf_dir):
    c, v, _ = _world(spark, sf_dir, False)
    m = c.join(isovist.isovist_stats(v).select("id", "area"), "id")
    return heatmap.heatmap(m, "area", log=True, flip=True).select("id", *r4("value"), "color")


@query("SELECT c_custkey AS id, printf('rgb(%d,%d,0)', CAST(floor(255 * t) AS INT), CAST(floor(255 * (1 - t)) AS INT)) AS color FROM (SELECT c_custkey, greatest(0.0, least(1.0, c_acctbal / 5000.0 / 2.0)) AS t FROM customer)")
def cost_ramp_rgb(spark, sf_dir):
    from .functions import color

    return fixture.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), color.cost_ramp(F.col("c_acctbal") / 5000.0).alias("color"))


@query(f"{BASE}o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, greatest(1, (count(*) OVER ()) // 7) AS s FROM centres) SELECT id, CAST(k // s AS INT) AS sample FROM o WHERE k % s = 0 AND k < 7 * s")
def experiment_sample(spark, sf_dir):
    return heatmap.experiment_sample(fixture.centres(spark, sf_dir))


@query(f"{BASE}{DUMMY} SELECT round(greatest(min(x), 2.0), 4) AS x, round(greatest(min(y) - 8.0, 16.0), 4) AS y FROM centres")
def measure_label(spark, sf_dir):
    return heatmap.measure_label(fixture.centres(spark, sf_dir), 0.0, 0.0).select(*r4("x", "y"))


@query(f"{FULL}{DUMMY} SELECT src, dst, round(dist, 4) AS dist FROM edges WHERE src = (SELECT min(id) FROM centres)")
def connections(spark, sf_dir):
    c, _, e = _world(spark, sf_dir)
    return heatmap.connections(e, c.agg(F.min("id")).first()[0]).select("src", "dst", *r4("dist"))


@query(f"{FULL}{REACH}, sz AS (SELECT component, count(*) AS n FROM comp GROUP BY component), mn AS (SELECT component AS m FROM sz ORDER BY n DESC, component LIMIT 1) SELECT src, dst, CASE WHEN component = m THEN '#999999' ELSE ['#e60000','#0066cc','#00994d','#cc7a00','#8000cc','#00a3a3','#cc0066','#808000'][(component - CASE WHEN component > m THEN 1 ELSE 0 END) % 8 + 1] END AS color FROM edges JOIN comp ON comp.id = src, mn WHERE src < dst")
def graph_drawing_rows(spark, sf_dir):
    c, _, e = _world(spark, sf_dir)
    return heatmap.graph_drawing(e, graph.components(e, c))


@query(f"{FULL}{HOPS}, od AS (SELECT min(id) AS o, max(id) AS d FROM centres) SELECT c.id, h.d AS depth FROM centres c, od LEFT JOIN hops h ON h.a = od.d AND h.id = c.id")
def topo_depth_map(spark, sf_dir):
    c, _, e = _world(spark, sf_dir)
    o, d = _pair(c).first()
    return heatmap.depth_colors(graph.depths(e, c.where(F.col("id") == d)), c, o, d).select("id", "depth")


def _paths(spark, sf_dir):
    """The obstacles as path strings."""
    p = F.col
    r = fixture.rings(spark, sf_dir).where("pid >= 0").groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("vi", "x", "y"))).alias("v"))
    return r.select("pid", F.concat(F.lit("M "), F.array_join(F.transform("v", lambda q: F.format_string("%.3f,%.3f", q["x"], q["y"])), " L "), F.lit(" z")).alias("d"), p("v"))


@query(f"{BASE}{DUMMY} SELECT pid, vi, round(x, 3) AS x, round(y, 3) AS y FROM rings WHERE pid >= 0")
def parse_paths(spark, sf_dir):
    d = _paths(spark, sf_dir).select("pid", F.posexplode(svgpath.parse_path(F.col("d"))).alias("vi", "p"))
    return d.select("pid", "vi", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@query(f"{BASE}{DUMMY} SELECT pid, string_agg(CASE WHEN vi = 0 THEN 'M' ELSE 'L' END || printf('%.3f', x) || ',' || printf('%.3f', y), ' ' ORDER BY vi) || ' z' AS d FROM rings WHERE pid >= 0 GROUP BY pid")
def simplify_paths(spark, sf_dir):
    return _paths(spark, sf_dir).select("pid", svgpath.simplify_path(F.col("d"))["d"].alias("d"))


@query()
def best_candidate_placement(spark, sf_dir):
    return place.best_candidates(spark, isovist.ring_edges(fixture.rings(spark, sf_dir)), n=fixture.table(spark, sf_dir, "supplier").count(), k=7, seed=42)


@query()
def heal_bridges(spark, sf_dir):
    c = written(fixture.centres(spark, sf_dir))
    healed, _, _ = place.heal(c, isovist.ring_edges(fixture.rings(spark, sf_dir)), seed=42)
    return healed


MEASURES = metrics.COLUMNS[3:]
_POLAR = _polar_sql("[1.0]").removeprefix(FULL).rpartition("\nSELECT")[0]
TABLE = f"""{FULL}{PATHS}, {ARCS}, {BETWEEN}, {PROSPECT.removeprefix(WAYS)}, {_POLAR},
mi AS (SELECT id, abs(sum(ax * by_ - bx * ay)) / 2 AS area, sum(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))) AS perimeter FROM isoe GROUP BY id),
mg AS (SELECT src AS id, count(*) AS degree FROM edges GROUP BY src),
mc AS (SELECT c.id, coalesce(sum(choice - coalesce(delta, 0)), 0) AS d_choice FROM centres c LEFT JOIN edges e ON e.src = c.id LEFT JOIN ch ON ch.id = e.dst LEFT JOIN dl ON dl.a = c.id AND dl.id = e.dst GROUP BY c.id),
mp AS (SELECT goal AS id, sum(ang) AS polar_status_angle, sum(c) AS polar_status_product FROM pl GROUP BY goal),
mt_ AS (SELECT a AS id, CAST(sum(d) AS DOUBLE) AS topo_status FROM lv GROUP BY a),
mr AS (SELECT c.id, coalesce(sum(c), 0) AS prospect_status FROM centres c LEFT JOIN po ON goal = c.id GROUP BY c.id),
ma AS (SELECT c.id, coalesce(sum(v), 0) * (180.0 / pi()) AS angular_integration FROM centres c LEFT JOIN (SELECT a, cur, min(c) AS v FROM ar WHERE cur <> a GROUP BY a, cur) ON a = c.id GROUP BY c.id),
me AS MATERIALIZED (SELECT c.id, c.x, c.y, area, perimeter, coalesce(degree, 0) AS degree, choice, d_choice, a_choice, polar_status_angle, polar_status_product, topo_status, prospect_status, angular_integration FROM centres c LEFT JOIN mi USING (id) LEFT JOIN mg USING (id) LEFT JOIN ch USING (id) LEFT JOIN mc USING (id) LEFT JOIN ac USING (id) LEFT JOIN mp USING (id) LEFT JOIN mt_ USING (id) LEFT JOIN mr USING (id) LEFT JOIN ma USING (id))"""
_R4 = ", ".join(f"round({c}, 4) AS {c}" if c != "degree" else c for c in ["x", "y", *MEASURES])


def _metrics(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c, e = _seen(spark, sf_dir)
    v = isovist.isovist_vertices(c, isovist.ring_edges(fixture.rings(spark, sf_dir)))
    return c, written(metrics.metrics(c, v, e))


@query(f"{TABLE} SELECT id, {_R4} FROM me")
def metrics_table(spark, sf_dir):
    m = _metrics(spark, sf_dir)[1]
    return m.select("id", *(F.col(c) if c == "degree" else F.round(c, 4).alias(c) for c in ["x", "y", *MEASURES]))


_LONG = " UNION ALL ".join(f"SELECT '{c}' AS measure, id, CAST({c} AS DOUBLE) AS v FROM me" for c in MEASURES)
_HEAT = HEAT.replace("id, v", "measure, id, v").replace("SELECT id, round", "SELECT measure, id, round")


@query(f"{TABLE}, t AS (SELECT measure, id, v, CASE WHEN max(v) OVER p > min(v) OVER p THEN (v - min(v) OVER p) / (max(v) OVER p - min(v) OVER p) ELSE 0.0 END AS t FROM ({_LONG}) WINDOW p AS (PARTITION BY measure)), {_HEAT.format(t='t')}")
def heatmap_measures(spark, sf_dir):
    """All eleven heatmaps."""
    from functools import reduce

    m = _metrics(spark, sf_dir)[1]
    return reduce(DataFrame.unionByName, (heatmap.heatmap(m, c).select(F.lit(c).alias("measure"), "id", *r4("value"), "color") for c in MEASURES))


_GATE_COLS = ", ".join(f"round(me.{c}, 4) AS {c}" if c != "degree" else f"me.{c}" for c in MEASURES)


@query(f"{TABLE}, {GATES.replace('<= 5.0', '<= 50.0')} SELECT gate_idx, label, round(gates.x, 4) AS x, round(gates.y, 4) AS y, count, round(CASE WHEN count > 0 THEN ln(CASE WHEN count > 0 THEN count ELSE 1 END) END, 4) AS log_count, round(me.x, 4) AS isovist_x, round(me.y, 4) AS isovist_y, isovist_id, {_GATE_COLS} FROM gates LEFT JOIN mt USING (gate_idx) LEFT JOIN me ON me.id = isovist_id")
def gate_report_full(spark, sf_dir):
    """All columns of the gate table, at the default radius."""
    c, m = _metrics(spark, sf_dir)
    out = gates.report(gates.match(fixture.gates(spark, sf_dir), c), c, m)
    return out.select("gate_idx", "label", *r4("x", "y"), "count", *r4("log_count", "isovist_x", "isovist_y"), "isovist_id", *(F.col(x) if x == "degree" else F.round(x, 4).alias(x) for x in MEASURES))


def _bezier_sql(pts: list[tuple[str, str]]) -> str:
    """Eight samples of a cubic curve by its four points."""
    w = ["(1-t)*(1-t)*(1-t)", "3*(1-t)*(1-t)*t", "3*(1-t)*t*t", "t*t*t"]
    return ", ".join(" + ".join(f"{k}*({p[i]})" for k, p in zip(w, pts, strict=True)) + f" AS {n}" for i, n in enumerate("xy"))


def _curves_sql() -> str:
    # u: whole numbers, so that all operands are exact decimals.
    u = "u AS (SELECT k, CAST(10 + 20 * (k % 5) AS DOUBLE) AS a, CAST(10 + 20 * (k // 5) AS DOUBLE) AS b, CAST(30 + 20 * (k % 5) AS DOUBLE) AS c, CAST(16 + 20 * (k // 5) AS DOUBLE) AS e FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation))"
    cubic = [("a", "b"), ("a", "e"), ("c", "e"), ("c", "b")]
    smooth = [("c", "b"), ("c", "b"), ("c+1.5", "b+2.5"), ("c+4", "b+0.5")]
    px, py = "c+4", "b+0.5"
    quad = [(px, py), (f"{px}+2.0/3.0*2", f"{py}+2.0/3.0*(-3)"), (f"{px}+4+2.0/3.0*(2-4)", f"{py}+1+2.0/3.0*(-3-1)"), (f"{px}+4", f"{py}+1")]
    lines = [("c+9", "b+2.5"), ("c+11.5", "b+2.5"), ("c+11.5", "b+1.25"), ("a", "b+1.25"), ("a+1.5", "b-0.75")]
    parts = ["SELECT k, 0 AS n, a AS x, b AS y FROM u"]
    for j, pts in enumerate((cubic, smooth, quad)):
        parts.append(f"SELECT k, {1 + 8 * j} + i - 1, {_bezier_sql(pts)} FROM (SELECT *, i / 8.0 AS t FROM u, range(1, 9) r(i))")
    parts += [f"SELECT k, {25 + j}, {x}, {y} FROM u" for j, (x, y) in enumerate(lines)]
    return f"WITH {u}, q AS ({' UNION ALL '.join(parts)}) SELECT k AS pid, CAST(n AS INT) AS vi, round(x, 3) AS x, round(y, 3) AS y FROM q"


@query(_curves_sql())
def parse_curves(spark, sf_dir):
    """A cubic, a smooth cubic (its first control point is the pen), a quadratic, a smooth quadratic and an arc as chords, steps along the axes."""
    k = F.col("n_nationkey").cast("long")
    n = lambda c: c.cast("int").cast("string")
    a, b, c, e = n(10 + 20 * (k % 5)), n(10 + 20 * F.floor(k / 5)), n(30 + 20 * (k % 5)), n(16 + 20 * F.floor(k / 5))
    text = F.concat(F.lit("M"), a, F.lit(" "), b, F.lit("C"), a, F.lit(" "), e, F.lit(","), c, F.lit(" "), e, F.lit(","), c, F.lit(" "), b, F.lit(" s1.5 2.5 4 .5 q 2-3 4,1 t1,1 h2.5 v-1.25 H"), a, F.lit(" a3 3 0 0 1 1.5-2z"))
    d = fixture.table(spark, sf_dir, "nation").select(k.alias("pid"), F.posexplode(svgpath.parse_path(text)).alias("vi", "p"))
    return d.select("pid", "vi", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))
