import math

import pytest
from pyspark.sql import functions as F

from sightline import cli
from sightline.operators import centrality, gates, graph, heatmap, isovist, metrics, place, routes
from sightline.sources import plans


def rings(spark, *shapes):
    return spark.createDataFrame([(p, i, float(x), float(y)) for p, shape in shapes for i, (x, y) in enumerate(shape)], "pid long, vi int, x double, y double")


def points(spark, *at):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "id long, x double, y double")


def network(spark, at, pairs):
    c = points(spark, *at)
    rows = [(a, b, *map(float, at[a]), *map(float, at[b]), math.dist(at[a], at[b])) for p in pairs for a, b in (p, p[::-1])]
    return c, spark.createDataFrame(rows, "src long, dst long, sx double, sy double, dx double, dy double, dist double")


def by_id(df, col):
    return {r.id: r[col] for r in df.collect()}


SQUARE = (-1, [(0, 0), (10, 0), (10, 10), (0, 10)])


@pytest.mark.parametrize(
    "shapes, at, area, perimeter, n",
    [
        ([SQUARE], (5, 5), 100, 40, 12),
        ([SQUARE], (3, 4), 100, 40, 12),
        ([(-1, [(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)])], (2, 8), 44, 26 + math.sqrt(20), 18),
        ([SQUARE, (0, [(4, 4), (6, 4), (6, 6), (4, 6)])], (1, 5), 76, None, 24),
    ],
)
def test_isovist(spark, shapes, at, area, perimeter, n):
    v = isovist.isovist_vertices(points(spark, at), isovist.ring_edges(rings(spark, *shapes)))
    r = isovist.isovist_stats(v).first()
    assert abs(r.area - area) < 1e-3 and r.n_vertices <= n
    assert perimeter is None or abs(r.perimeter - perimeter) < 1e-3


def test_plan(spark):
    r = rings(spark, SQUARE, (0, [(4, 4), (6, 4), (6, 6), (4, 6)]), (1, [(0, 0), (1, 1)]))
    assert isovist.open_area(r).first()[0] == 96
    roles = {x.pid: x.role for x in isovist.classify(r).collect()}
    assert roles == {-1: "outer", 0: "obstacle"}
    ok = isovist.valid_points(points(spark, (1, 1), (5, 5), (11, 1)), r)
    assert [x.id for x in ok.collect()] == [0]


def test_path_graph(spark):
    c, e = network(spark, [(0, 0), (1, 0), (2, 0), (3, 0)], [(0, 1), (1, 2), (2, 3)])
    depth = graph.depths(e, c)
    delta = centrality.dependencies(e, depth)
    arcs = centrality.arc_costs(e, centrality.turns(e))
    assert by_id(centrality.choice(delta), "choice") == {0: 0, 1: 4, 2: 4, 3: 0}
    assert by_id(centrality.d_choice(delta, e), "d_choice") == {0: 2, 1: 3, 2: 3, 3: 2}
    assert by_id(graph.topo_status(depth, c), "topo_status") == {0: 6, 1: 4, 2: 4, 3: 6}
    assert by_id(centrality.a_choice(arcs, e, c), "a_choice") == {0: 4, 1: 4, 2: 4, 3: 4}
    assert all(abs(v) < 1e-4 for v in by_id(centrality.angular_integration(arcs, c), "angular_integration").values())


def test_star(spark):
    c, e = network(spark, [(0, 0), (1, 0), (0, 1), (-1, 0)], [(0, 1), (0, 2), (0, 3)])
    delta = centrality.dependencies(e, graph.depths(e, c))
    assert by_id(centrality.choice(delta), "choice") == {0: 6, 1: 0, 2: 0, 3: 0}
    assert by_id(centrality.d_choice(delta, e), "d_choice") == {0: 0, 1: 4, 2: 4, 3: 4}
    assert by_id(graph.degree(e, c), "degree") == {0: 3, 1: 1, 2: 1, 3: 1}


GRID = [(0, 0), (2, 0.3), (4, -0.2), (0.2, 2), (2.1, 2.2), (4, 1.9), (0, 4.2), (2, 4), (4.3, 4)]
LINKS = [(0, 1), (1, 2), (3, 4), (4, 5), (6, 7), (7, 8), (0, 3), (3, 6), (1, 4), (4, 7), (2, 5), (5, 8), (0, 4), (4, 8)]


def test_statuses_are_sums_of_routes(spark):
    c, e = network(spark, GRID, LINKS)
    pairs = c.select(F.col("id").alias("origin")).join(c.select(F.col("id").alias("dest")), F.col("origin") != F.col("dest"))
    total = lambda df, key: {r[key]: r.s for r in df.groupBy(key).agg(F.sum("total").alias("s")).collect()}
    close = lambda a, b: a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)
    assert close(by_id(centrality.polar_status(e, c, 1.0), "polar_status_product"), total(routes.polar_route(pairs, c, e), "dest"))
    assert close(by_id(centrality.prospect_status(e, c), "prospect_status"), total(routes.prospect_route(pairs, c, e), "dest"))
    arcs = centrality.arc_costs(e, centrality.turns(e))
    got = {k: v * 180 / math.pi for k, v in total(routes.angular_route(pairs, c, e), "origin").items()}
    assert close(by_id(centrality.angular_integration(arcs, c), "angular_integration"), got)
    metric = routes.metric_route(pairs, c, e).collect()
    flat = {(r.origin, r.dest): r.total for r in routes.polar_route(pairs, c, e, gamma=0.0).collect()}
    for r in metric:
        assert abs(r.total - sum(r.edge_costs)) < 1e-9 and r.total >= math.dist(GRID[r.origin], GRID[r.dest]) - 1e-9
        assert abs(flat[r.origin, r.dest] - r.total) < 1e-9
    for r in routes.nose_route(pairs, c, e).collect():
        assert r.topo_depths == sorted(r.topo_depths, reverse=True) and r.edge_costs[-1] <= 1e-6
    for r in routes.topo_route(pairs, c, e).collect():
        assert r.total == len(r.path) - 1 == r.topo_depths[0]


def test_route_edges(spark):
    c, e = network(spark, [(0, 0), (1, 0), (5, 5)], [(0, 1)])
    pairs = spark.createDataFrame([(0, 0), (0, 2), (0, 1)], "origin long, dest long")
    for f in (routes.metric_route, routes.polar_route, routes.nose_route, routes.topo_route, routes.angular_route, routes.prospect_route):
        got = {r.dest: (r.path, r.total) for r in f(pairs, c, e).collect()}
        assert got[0] == ([0], 0.0) and got[2] == ([], math.inf) and got[1][0] == [0, 1]


def test_components(spark):
    c, e = network(spark, [(0, 0), (1, 0), (5, 5), (6, 5), (9, 9)], [(0, 1), (2, 3)])
    parts = graph.components(e, c)
    assert by_id(parts, "component") == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}
    with pytest.raises(graph.DisconnectedGraphError):
        graph.require_connected(parts)


def test_gate_ties(spark):
    c = points(spark, (0, 0), (10, 0))
    g = spark.createDataFrame([(0, "a", 5.0, 0.0, 3.0), (1, "a", 50.0, 50.0, 0.0)], "gate_idx long, label string, x double, y double, count double")
    at = lambda r: {x.gate_idx: x.isovist_id for x in gates.match(g, c, r).collect()}
    assert at(5.0) == {0: 1, 1: None} and at(4.9) == {0: None, 1: None}


def test_colors(spark):
    m = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 5.0), (2, 0.0, 0.0, 10.0)], "id long, x double, y double, v double")
    assert by_id(heatmap.heatmap(m, "v"), "color") == {0: "#e60000", 1: "#00e600", 2: "#0000e6"}
    assert by_id(heatmap.heatmap(m, "v", flip=True), "color") == {0: "#0000e6", 1: "#00e600", 2: "#e60000"}
    assert set(by_id(heatmap.heatmap(m.withColumn("v", F.lit(1.0)), "v"), "color").values()) == {"#e60000"}


SVG = """<?xml version="1.0"?>
<svg xmlns="http://www.w3.org/2000/svg" width="20" height="10" viewBox="0,0,20,10">
<g><path d="M0,0 L20,0 20,10 0,10 z"/><path d="M9,0 L11,0 L11,8.5 9,8.5 z"/><path d="M1 1"/></g></svg>"""


def test_command_line(spark, tmp_path):
    plan = tmp_path / "plan.svg"
    plan.write_text(SVG)
    net = tmp_path / "net.csv"
    net.write_text("id,x,y\n0,4,5\n1,10,9.8\n2,16,5\n3,5,7\n")
    gate = tmp_path / "gates.csv"
    gate.write_text("﻿label,x,y,count\nA,4,5.5,10\nB,bad,1,2\nB,16,5,0,extra")
    made = cli.run(spark, [str(plan), "--NETWORK-RESTORE", str(net), "--gates", str(gate), "--T", "--vis-choice", "--vis-polar-single", "--ODseed", "0", "2", "--vis-graph", "--vis-connections", "--NETWORK", str(tmp_path / "saved"), "--out", str(tmp_path / "out")])
    assert {"centers", "csv", "gates-csv", "gates", "choice", "polar", "graph", "connections", "network", "experiment"} <= set(made)
    for kind, path in made.items():
        if path.endswith(".svg"):
            assert open(path).read().count("</svg>") == 1
    rows = spark.read.option("header", True).csv(made["csv"]).collect()
    assert len(rows) == 4 and rows[0].__fields__ == metrics.COLUMNS and len(rows[0].area.split(".")[1]) == 4
    got = spark.read.option("header", True).csv(made["gates-csv"]).collect()
    assert len(got) == 2 and len(got[0]) == 19 and got[1].log_count is None and got[0].isovist_id == "0"
    text, did = plans.simplify_plan(spark, str(plan))
    assert did["paths"] == 3 and 'd="M0.000,0.000' in text


def test_placement_and_heal(spark):
    wall = (0, [(4.8, 0), (5.2, 0), (5.2, 9), (4.8, 9)])
    segments = isovist.ring_edges(rings(spark, SQUARE, wall))
    placed = place.best_candidates(spark, segments, 12, 7, 1).collect()
    assert placed == place.best_candidates(spark, segments, 12, 7, 1).collect() and len(placed) == 12
    assert isovist.valid_points(spark.createDataFrame(placed), rings(spark, SQUARE, wall)).count() == 12
    c, _, e = place.heal(points(spark, (1, 1), (9, 1)), segments, 3)
    assert c.count() > 2
    graph.require_connected(graph.components(e, c))


def test_empty(spark):
    c = spark.createDataFrame([], "id long, x double, y double")
    segments = isovist.ring_edges(rings(spark, SQUARE))
    v = isovist.isovist_vertices(c, segments)
    e = graph.visibility_edges(v, c)
    assert e.count() == 0 and graph.components(e, c).count() == 0 and graph.depths(e, c).count() == 0
