"""A plan too large to go to every task gives the same polygons."""

from sightline.operators import isovist

SQUARE = [(-1, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (10, 0), (10, 10), (0, 10)])]
BLOCK = [(0, i, float(x), float(y)) for i, (x, y) in enumerate([(4, 4), (6, 4), (6, 6), (4, 6)])]


def test_without_broadcast(spark, monkeypatch):
    rings = spark.createDataFrame(SQUARE + BLOCK, "pid int, vi int, x double, y double")
    points = spark.createDataFrame([(0, 1.0, 1.0), (1, 5.0, 5.0), (2, 8.0, 3.0), (3, 12.0, 1.0)], "id long, x double, y double")
    segments = isovist.ring_edges(rings)

    def answers():
        inside = isovist.valid_points(points, rings)
        return sorted(r.id for r in inside.collect()), sorted(tuple(r) for r in isovist.isovist_vertices(inside, segments).collect())

    few = answers()
    monkeypatch.setattr(isovist, "SEGMENTS", 1)
    assert few[0] == [0, 2] and answers() == few
