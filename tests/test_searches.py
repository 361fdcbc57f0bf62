"""Small graphs: searches in tasks, rounds of joins, and rules by hand give the same."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import centrality, graph, routes
from test_spatial import GRID, LINKS, by_id, network, points

FINDERS = [routes.polar_route, routes.nose_route, routes.topo_route, routes.angular_route, routes.prospect_route]


@pytest.fixture(scope="module")
def some(spark):
    """Eleven nodes with an island of two and a lone node."""
    c, e = network(spark, [*GRID, (9, 9), (9, 10), (20, 20)], [*LINKS, (9, 10)])
    return c.cache(), e.cache()


def rows(df):
    near = lambda v: round(v, 9) if isinstance(v, float) else [near(x) for x in v] if isinstance(v, list) else v
    return sorted((tuple(near(v) for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("find", FINDERS)
def test_routes(spark, some, find):
    c, e = some
    pairs = spark.createDataFrame([(0, 8), (8, 0), (6, 2), (3, 3), (0, 9), (10, 9), (11, 0), (4, 1)], "origin long, dest long")
    assert rows(find(pairs, c, e)) == rows(find(pairs, c, e, arcs=0))


def test_measures(spark, some):
    c, e = some
    for f in (graph.depths, graph.components, lambda e, c, **o: centrality.polar_status(e, c, [1.0, 2.5], **o), centrality.prospect_status):
        assert rows(f(e, c)) == rows(f(e, c, arcs=0))
    assert rows(centrality.arc_costs(e)) == rows(centrality.arc_costs(e, arcs=0))
    assert rows(centrality.arc_costs(e, whole=centrality.WHOLE)) == rows(centrality.arc_costs(e, arcs=0, whole=centrality.WHOLE))
    assert rows(centrality.dependencies(e, graph.depths(e, c))) == rows(centrality.dependencies(e, graph.depths(e, c, arcs=0), arcs=0))


@pytest.mark.parametrize("arcs", [0, 10**6])
def test_topo_ties(spark, arcs):
    """Of the neighbours one hop nearer the lowest id, seen from the origin."""
    c, e = network(spark, [(i, i * i % 7) for i in range(11)], [(0, 5), (0, 6), (5, 9), (6, 8), (8, 10), (9, 10)])
    pairs = spark.createDataFrame([(0, 10)], "origin long, dest long")
    assert routes.topo_route(pairs, c, e, arcs=arcs).first().path == [0, 5, 9, 10]
    side, at = 4, random.Random(3).sample(range(16), 16)
    near = [(at[i], at[j]) for i in range(16) for j in range(i) if abs(i // side - j // side) + abs(i % side - j % side) == 1]
    c, e = network(spark, [(i, i * i % 7) for i in range(16)], near)
    hops = {(r.anchor, r.id): r.depth for r in graph.depths(e, c).collect()}
    pairs = c.select(F.col("id").alias("origin")).crossJoin(c.select(F.col("id").alias("dest")))
    for r in routes.topo_route(pairs, c, e, arcs=arcs).collect():
        path = [r.origin]
        while path[-1] != r.dest:
            path.append(min(b for p in near for a, b in (p, p[::-1]) if a == path[-1] and hops[r.dest, b] == hops[r.dest, a] - 1))
        assert r.path == path and r.total == len(path) - 1 and r.topo_depths == list(range(len(path)))[::-1]


@pytest.mark.parametrize("arcs", [0, 10**6])
def test_no_edges(spark, arcs):
    c = points(spark, (0, 0), (1, 0))
    _, e = network(spark, [(0, 0), (1, 0)], [(0, 1)])
    e = e.limit(0)
    assert by_id(centrality.a_choice(centrality.arc_costs(e, arcs=arcs), e, c), "a_choice") == {0: 0, 1: 0}
    assert by_id(centrality.prospect_status(e, c, arcs=arcs), "prospect_status") == {0: 0, 1: 0}
    assert by_id(centrality.polar_status(e, c, arcs=arcs), "polar_status_product") == {0: 0, 1: 0}
    assert by_id(centrality.choice(centrality.dependencies(e, graph.depths(e, c, arcs=arcs), arcs=arcs)), "choice") == {0: 0, 1: 0}
    assert by_id(graph.components(e, c, arcs=arcs), "component") == {0: 0, 1: 1}
    assert math.isinf(routes.angular_route(spark.createDataFrame([(0, 1)], "origin long, dest long"), c, e, arcs=arcs).first().total)


def test_sizes_descend(spark):
    c, e = network(spark, [(i, 0) for i in range(6)], [(1, 2), (2, 3), (4, 5)])
    assert [(r.component, r["size"]) for r in graph.component_sizes(graph.components(e, c)).collect()] == [(1, 3), (2, 2), (0, 1)]
