"""The graph as bits: its arcs are those of the join, and searches in it find what those over rows of arcs find."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline import registry
from sightline.operators import _local, centrality, graph, isovist, metrics, place, routes, sights
from sightline.plans import fixture
from test_searches import rows


def values(df):
    return {r[0]: r[1] for r in df.collect()}


@pytest.fixture(scope="module")
def world(spark):
    c = fixture.centres(spark, "/root/testdata/sf0.01").cache()
    plan = isovist.ring_edges(fixture.rings(spark, "/root/testdata/sf0.01"))
    return c, graph.visibility_edges(isovist.isovist_vertices(c, plan), c).cache(), sights.sights(c, plan), plan


@pytest.fixture(scope="module")
def pairs(world):
    return world[0].agg(F.min("id").alias("origin"), F.max("id").alias("dest")).union(world[0].agg(F.min("id"), F.max("id") - 1)).union(world[0].agg(F.max("id") - 3, F.min("id") + 2)).cache()


def test_arcs(world):
    _, e, seen, _ = world
    assert rows(e) == rows(seen.edges()) and seen.count() == e.count()


def test_points_near_rays_and_edges(spark):
    """Centres a hair off the sight lines past corners, some at one place: as the crossings say. (Exactly on an edge the last digit of a sine decides, here
    as between Spark and SQL.)"""
    shapes = [(-1, [(0, 0), (10, 0), (10, 10), (0, 10)]), (0, [(4, 4), (6, 4), (6, 6), (4, 6)])]
    rings = spark.createDataFrame([(p, i, float(x), float(y)) for p, s in shapes for i, (x, y) in enumerate(s)], "pid long, vi int, x double, y double")
    c = spark.createDataFrame([(7 * i, i % 11 + 1e-8 * (i * i % 13 - 5.5), i // 11 + 1e-8 * (i * i % 17 - 7.5)) for i in range(121)] + [(1000, 1 + 1e-8 * 4.5, 1.0)], "id long, x double, y double")
    c = isovist.valid_points(c, rings)
    plan = isovist.ring_edges(rings)
    assert rows(sights.sights(c, plan).edges()) == rows(graph.visibility_edges(isovist.isovist_vertices(c, plan), c))


def test_too_many(world, monkeypatch):
    monkeypatch.setattr(sights, "POINTS", 3)
    assert sights.sights(world[0], world[3]) is None


def test_empty(world):
    assert sights.sights(world[0].limit(0), world[3]).edges().count() == 0


def test_nose_route(world, pairs):
    c, e, seen, _ = world
    assert rows(routes.nose_route(pairs, c, seen)) == rows(routes.nose_route(pairs, c, e)) == rows(routes.nose_route(pairs, c, e, arcs=0))


def test_polar_route(world, pairs):
    c, e, seen, _ = world
    assert rows(routes.polar_route(pairs, c, seen)) == rows(routes.polar_route(pairs, c, e)) == rows(routes.polar_route(pairs, c, e, arcs=0))
    assert rows(routes.metric_route(pairs, c, seen)) == rows(routes.metric_route(pairs, c, e))


def test_polar_sweep(world, pairs):
    """One job for all exponents."""
    c, e, seen, _ = world
    assert rows(routes.polar_sweep(pairs, c, seen, [1.0, 2.4])) == rows(routes.polar_sweep(pairs, c, e, [1.0, 2.4]))


def test_hops(world):
    c, e, seen, _ = world
    assert rows(graph.depths(seen, c)) == rows(graph.depths(e, c)) == rows(graph.depths(e, c, arcs=0))
    assert rows(graph.topo_status(seen, c)) == rows(graph.topo_status(graph.depths(e, c), c))


def test_choices(world):
    c, e, seen, _ = world
    delta = centrality.dependencies(e, graph.depths(e, c))
    assert rows(centrality.choices(seen).select("id", F.round("choice", 6), F.round("d_choice", 6))) == rows(centrality.choice(delta).join(centrality.d_choice(delta, e), "id").select("id", F.round("choice", 6), F.round("d_choice", 6)))


@pytest.mark.parametrize("name", ["choice", "d_choice", "topo_depth", "topo_status", "polar_status", "polar_gamma_sweep"])
def test_no_arcs_as_rows(spark, monkeypatch, name):
    """These queries list no arcs: they are the square of the viewpoints."""
    monkeypatch.setattr(graph, "visibility_edges", None)
    monkeypatch.setattr(sights.Sights, "edges", None)
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("find", [routes.angular_route, routes.prospect_route])
def test_arc_routes(world, pairs, find):
    c, e, seen, _ = world
    assert rows(find(pairs, c, seen)) == rows(find(pairs, c, e)) == rows(find(pairs, c, e, arcs=0))


def test_heal_lists_no_arcs(spark, world, monkeypatch):
    """Islands are found in the bits."""
    c, e, seen, plan = world
    assert rows(graph.components(seen, c)) == rows(graph.components(e, c))
    monkeypatch.setattr(graph, "visibility_edges", None)
    healed, _, edges = place.heal(c, plan, 42)
    assert healed.count() > c.count()
    graph.require_connected(graph.components(edges, healed))


def test_free_turn(spark):
    """Over two nodes at one place any turn is free, so no bound by headings holds there."""
    from test_spatial import network

    c, e = network(spark, [(0, 0), (4, 0), (4, 0), (4, 4), (0.2, 4), (8, 2)], [(0, 1), (1, 2), (2, 3), (0, 4), (4, 3), (0, 5), (5, 3)])
    one = spark.createDataFrame([(0, 3)], "origin long, dest long")
    assert rows(routes.angular_route(one, c, e)) == rows(routes.angular_route(one, c, e, arcs=0))
    assert routes.angular_route(one, c, e).first().total < 1e-6


def test_polar_costs(world):
    """Arcs are left out by bounds in single precision; costs, angles and ties are those of the plain search, also between points at one place or in one line."""
    import numpy as np
    from sightline.operators import _local, _polar

    ids = np.arange(60)
    x, y = (ids * 7 % 13 + 0.25 * (ids > 40)).astype(float), (ids * 5 % 11).astype(float)
    sees = np.abs(x[:, None] - x) + np.abs(y[:, None] - y) < 5
    sees[55:], sees[:, 55:] = False, False
    a, b = np.nonzero(sees & (ids[:, None] != ids))
    bare = _local.Net(a, b, x[a], y[a], x[b], y[b], np.hypot(x[b] - x[a], y[b] - y[a]))
    for net in (bare, _local.net(world[1])):
        for at in range(0, len(net.ids), 7):
            units = net.off_goal(slice(None), net.x[at], net.y[at]) * (180.0 / np.pi) / 90.0
            for gamma in (0.0, 0.5, 1.0, 2.4, 6.0, 16.0):
                cost, _, angle = net.cheapest(at, np.power(units, gamma) * net.dist, back=True, extra=units)
                got = _polar.costs(net, at, net.x[at], net.y[at], gamma)
                assert (got[0] == cost).all() and (got[1] == angle).all()


def test_polar_status(world):
    c, e, seen, _ = world
    assert rows(centrality.polar_status(seen, c, [1.0, 3.0])) == rows(centrality.polar_status(e, c, [1.0, 3.0]))


def test_prospect_status_by_bearing(world):
    """Also on lines of centres, over which a way costs the same up to rounding."""
    c, e, seen, plan = world
    for weight in (1.0, 0.4):
        assert values(centrality.prospect_status(seen, c, weight)) == pytest.approx(values(centrality.prospect_status(e, c, weight)), rel=0, abs=1e-9)


def test_angular_integration_by_bearing(world):
    c, e, seen, plan = world
    assert values(centrality.angular_integration(seen, c)) == pytest.approx(values(centrality.angular_integration(centrality.arc_costs(e), c)), rel=0, abs=1e-7)


@pytest.mark.parametrize("apart", [0.0, 200.0])
def test_least_turns_with_lines_twins_and_islands(spark, apart):
    """A lattice, whose lines are straight; twins at one place; a part that is not seen."""
    plan = isovist.ring_edges(spark.createDataFrame([(p, i, float(x), float(y)) for p, s in enumerate([[(-1, -1), (9, -1), (9, 9), (-1, 9)], [(3.5, 2.3), (5.6, 2.3), (5.6, 5.4), (3.5, 5.4)], [(20, 0), (24, 0), (24, 4), (20, 4)]]) for i, (x, y) in enumerate(s)], "pid long, vi int, x double, y double"))
    places = [(3 * (6 * i + j), 1.5 * i, 1.4 * j) for i in range(6) for j in range(6) if not (3.5 <= 1.5 * i <= 5.6 and 2.3 <= 1.4 * j <= 5.4)]
    places += [(200, 21.0, 1.0), (201, 22.0, 3.0), (202, 23.0, 1.3)] + ([(300, 1.5, 1.4)] if not apart else [])
    c = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in places], "id long, x double, y double").cache()
    seen = sights.sights(c, plan)
    e = seen.edges().cache()
    assert values(centrality.prospect_status(seen, c)) == pytest.approx(values(centrality.prospect_status(e, c)), rel=0, abs=1e-9)
    assert values(centrality.angular_integration(seen, c)) == pytest.approx(values(centrality.angular_integration(centrality.arc_costs(e), c)), rel=0, abs=1e-5)


def test_least_turns_write_no_arcs(world, monkeypatch):
    """Nor rows for each start and arc."""
    c, _, seen, _ = world
    monkeypatch.setattr(sights.Sights, "edges", lambda self: pytest.fail("arcs as rows"))
    assert centrality.prospect_status(seen, c).count() == centrality.angular_integration(seen, c).count() == c.count()


def test_a_choice_from_bits(world):
    """Counts are whole numbers, the choice among ways of equal turn is that of the full search."""
    c, e, seen, _ = world
    assert rows(centrality.a_choice(seen, seen, c)) == rows(centrality.a_choice(centrality.arc_costs(e, whole=centrality.WHOLE), e, c))
    both = {r.id: r for r in centrality.turn_measures(seen, c).collect()}
    assert {k: r.a_choice for k, r in both.items()} == values(centrality.a_choice(seen, seen, c))
    assert {k: r.angular_integration for k, r in both.items()} == pytest.approx(values(centrality.angular_integration(seen, c)), rel=0, abs=1e-9)


@pytest.mark.parametrize("twins", [0, 2])
def test_a_choice_with_lines_twins_and_islands(spark, twins):
    """On lines of centres nearly straight bends cost up to 20 parts each; over twins a turn is free; a part is not seen."""
    plan = isovist.ring_edges(spark.createDataFrame([(p, i, float(x), float(y)) for p, s in enumerate([[(-1, -1), (9, -1), (9, 9), (-1, 9)], [(3.5, 2.3), (5.6, 2.3), (5.6, 5.4), (3.5, 5.4)], [(20, 0), (24, 0), (24, 4), (20, 4)]]) for i, (x, y) in enumerate(s)], "pid long, vi int, x double, y double"))
    places = [(3 * (6 * i + j), 1.5 * i, 1.4 * j) for i in range(6) for j in range(6) if not (3.5 <= 1.5 * i <= 5.6 and 2.3 <= 1.4 * j <= 5.4)]
    places += [(200, 21.0, 1.0), (201, 22.0, 3.0), (202, 23.0, 1.3)] + [(300, 1.5, 1.4)][: twins // 2]
    c = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in places], "id long, x double, y double").cache()
    seen = sights.sights(c, plan)
    e = seen.edges().cache()
    assert rows(centrality.a_choice(seen, seen, c)) == rows(centrality.a_choice(centrality.arc_costs(e, whole=centrality.WHOLE), e, c))


def test_a_choice_writes_no_arcs(spark, monkeypatch):
    monkeypatch.setattr(graph, "visibility_edges", None)
    monkeypatch.setattr(sights.Sights, "edges", None)
    assert registry.QUERIES["a_choice"](spark, "/root/testdata/sf0.001").count() > 0


def test_a_choice_of_nothing(world):
    none = world[0].limit(0)
    seen = sights.sights(none, world[3])
    assert centrality.a_choice(seen, seen, none).count() == 0


def test_metrics_from_bits(world, monkeypatch):
    """All columns are those over rows of arcs; none are listed."""
    c, e, seen, plan = world
    v = isovist.isovist_vertices(c, plan)
    table = lambda df: {r.id: {k: v for k, v in r.asDict().items() if v is not None} for r in df.collect()}
    want = table(metrics.metrics(c, v, e))
    monkeypatch.setattr(sights.Sights, "edges", None)
    got = metrics.metrics(c, v, seen)
    assert got.columns == metrics.COLUMNS and got.schema["degree"].dataType == metrics.metrics(c, v, e).schema["degree"].dataType
    got = table(got)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-6) for k in want)
    few = table(metrics.metrics(c, v, seen, only={"degree", "topo_status", "a_choice"}))
    assert all(few[k] == pytest.approx({m: want[k][m] for m in ("id", "x", "y", "degree", "topo_status", "a_choice")}, rel=1e-9, abs=1e-6) for k in want)


def test_metrics_write_no_arcs(spark, monkeypatch):
    monkeypatch.setattr(graph, "visibility_edges", None)
    monkeypatch.setattr(sights.Sights, "edges", None)
    assert registry.QUERIES["metrics_table"](spark, "/root/testdata/sf0.001").count() > 0


def test_gate_report_writes_no_arcs(spark, monkeypatch):
    monkeypatch.setattr(graph, "visibility_edges", None)
    monkeypatch.setattr(sights.Sights, "edges", None)
    out = registry.QUERIES["gate_report_full"](spark, "/root/testdata/sf0.001")
    assert out.count() == fixture.gates(spark, "/root/testdata/sf0.001").count()


def test_heatmaps_write_no_arcs(spark, monkeypatch):
    monkeypatch.setattr(graph, "visibility_edges", None)
    monkeypatch.setattr(sights.Sights, "edges", None)
    out = registry.QUERIES["heatmap_measures"](spark, "/root/testdata/sf0.001")
    assert {r.measure for r in out.collect()} == set(registry.MEASURES)


class Here(sights.Sights):
    """A graph whose searches run in this process."""

    def __init__(self, bits):
        self.bits = bits

    def each(self, search, schema, rows=None, block=sights.BLOCK):
        return [search(self.bits, np.arange(k, min(k + block, len(self.bits.ids)))) for k in range(0, len(self.bits.ids), block)]


@pytest.mark.parametrize("spread", [1, 3, 128])
@pytest.mark.parametrize("share", [0.0, 0.01, 0.04, 0.3])
def test_hops(monkeypatch, spread, share):
    """Hops need no products of matrices, of which a graph of 50 000 nodes would take hours, and are those of `levels`."""
    n, rng = 151, np.random.default_rng(int(share * 100))
    full = np.triu(rng.random((n, n)) < share, 1)
    bits = sights.Bits(np.arange(n) * 3, np.zeros(n), np.zeros(n), [np.packbits(full[i, i >> 3 << 3 :]).tobytes() for i in range(n)])
    assert (bits.matrix(0, n) == (full | full.T)).all()
    expected = bits.levels(np.arange(n))[0]
    monkeypatch.setattr(sights, "SPREAD", spread)
    monkeypatch.setattr(sights.Bits, "product", None)
    assert all((bits.hops(k) == expected[k]).all() for k in range(n))
    assert [v for part in graph.topo_status(Here(bits), None) for v in part["topo_status"]] == np.maximum(expected, 0).sum(1).tolist()
    got = [tuple(int(x) for x in r) for part in graph.hops(Here(bits), None) for r in zip(part["anchor"], part["id"], part["depth"], strict=True)]
    assert got == [(3 * a, 3 * b, expected[a, b]) for a, b in np.argwhere(expected >= 0).tolist()]


def test_mapped(monkeypatch):
    """A large graph lies in a file, and is the same."""
    n, rng = 9001, np.random.default_rng(5)
    parts = [np.packbits(np.append(np.zeros(i % 8 + 1, bool), rng.random(n - i - 1) < 0.01)).tobytes() for i in range(n)]
    one = sights.Bits(np.arange(n), np.zeros(n), np.zeros(n), parts)
    monkeypatch.setattr(sights, "MAPPED", 0)
    two = sights.Bits(np.arange(n), np.zeros(n), np.zeros(n), parts)
    assert isinstance(two.rows.base, np.memmap) and (one.rows == two.rows).all()
    for k in (0, 4095, 4096, 8192, 9000):
        assert (one.matrix(k, k + 1)[0] == [one.rows[i, k >> 3] >> (7 - k % 8) & 1 for i in range(n)]).all()


def test_made_once(world):
    """Tasks of one process make the graph once."""
    def count(bits, at):
        bits.asked = getattr(bits, "asked", 0) + 1
        return {"n": [bits.asked]}

    assert max(r.n for r in world[2].each(count, "n int").collect()) > 1


def test_topo_depth(world):
    c, e, seen, _ = world
    assert rows(graph.hops(seen, c)) == rows(graph.hops(e, c)) == rows(graph.depths(e, c).select("anchor", "id", "depth"))


@pytest.mark.parametrize("find", [routes.angular_route, routes.prospect_route])
def test_routes_list_no_arcs(monkeypatch, world, pairs, find):
    """Only the arcs near the best way, whatever the graph's size: beyond 16 million arcs all were written as rows."""
    c, e, seen, _ = world
    expected = rows(find(pairs, c, e))
    monkeypatch.setattr(sights.Sights, "edges", None)
    monkeypatch.setattr(sights.Sights, "count", lambda self: 700_000_000)
    assert rows(find(pairs, c, seen)) == expected


@pytest.mark.parametrize("seed", range(6))
def test_near_best(seed):
    """Ways of many arcs, over all arcs and over those near the best way."""
    n, rng = 120, np.random.default_rng(seed)
    x, y = rng.random(n) * 10, rng.random(n) * (10 if seed % 2 else 2)
    full = np.triu((np.hypot(x[:, None] - x, y[:, None] - y) < (1.3, 2.0, 4.0)[seed % 3]) & (rng.random((n, n)) < 0.8), 1)
    bits = sights.Bits(np.arange(n), x, y, [np.packbits(full[i, i >> 3 << 3 :]).tobytes() for i in range(n)])
    net, found, longest = _local.Net.of(bits), 0, 0
    for o, d in rng.integers(0, n, (60, 2)).tolist():
        if o == d:
            continue
        for goal, weight in ((False, 1.0), (True, 1.0), (True, 0.2), (True, 0.0)):
            def costs(graph, goal=goal, weight=weight, d=d):
                off = graph.off_goal(slice(None), x[d], y[d])
                return (lambda a: off[a], lambda i, j: off[j] + weight * graph.heading(i, j)) if goal else (lambda a: np.zeros(len(a)), graph.turn)

            few = routes._near_best(bits, o, d, weight, goal)
            one, two = routes._over(net, o, d, *costs(net), weight), few and routes._over(few[0], o, d, *costs(few[0]), weight, few[1])
            assert (one is None) == (two is None)
            if one:
                assert [int(v) for v in one[0]] == [int(v) for v in two[0]] and [float(v) for v in one[1]] == [float(v) for v in two[1]]
                found, longest = found + 1, max(longest, len(one[1]))
    assert found > 100 and longest > 3


def test_spread():
    at = np.arange(1000.0) * 0.1
    assert sights.Sights(None, at, at, at[::-1]).spread()
    assert not sights.Sights(None, at, np.append(at[:-1], at[3] + 5e-13), np.append(at[:-1], at[3] - 5e-13)).spread()


def test_polar_status_lists_no_arcs(monkeypatch, world):
    """Beyond 16 million arcs ways are searched in the bits; all arcs were written as rows."""
    c, e, seen, _ = world
    some, gammas = c.where("id % 3 = 0").cache(), [1.0, 2.6, 0.0, 20.0]
    expected = rows(centrality.polar_status(e, some, gammas))
    monkeypatch.setattr(sights.Sights, "edges", None)
    monkeypatch.setattr(sights.Sights, "count", lambda self: 700_000_000)
    assert rows(centrality.polar_status(seen, some, gammas)) == expected


def test_cheapest_back(monkeypatch):
    """Equal costs: the earlier round, then the least parent."""
    n, rng = 90, np.random.default_rng(8)
    full = np.triu(rng.random((n, n)) < 0.06, 1)
    bits = sights.Bits(np.arange(n), np.zeros(n), np.zeros(n), [np.packbits(full[i, i >> 3 << 3 :]).tobytes() for i in range(n)])
    net, table, other = _local.Net.of(bits), rng.integers(0, 3, (n, n)).astype(float), rng.random((n, n))
    for together in (50, 10**6):
        monkeypatch.setattr(sights, "TOGETHER", together)
        for to in range(n):
            one, two = bits.cheapest_back(to, lambda u, a, b: table[a, b], lambda a, b: other[a, b]), net.cheapest(to, table[net.src, net.dst], back=True, extra=other[net.src, net.dst])
            assert (one[0] == two[0]).all() and (one[1] == two[2]).all()
