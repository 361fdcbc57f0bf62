"""Who sees whom, as bits.

Where a plan's segments go to every task (counted first) and the viewpoints are at most POINTS, a task computes its viewpoints' polygons and tests all
higher-numbered viewpoints against them at once: nothing is shuffled, and of a pair one bit is written (52 000 viewpoints: 0.17 GB, where their
arcs as rows are about 700 million). A viewpoint lies in one sector of a polygon, between two rays, and is held against that sector's edge; where it is
as near to an edge or a ray as rounding reaches, the crossings of all edges are counted, as `graph.visibility_edges` does."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..scratch import written
from . import isovist

#: Viewpoints whose graph is held as bits (half a GB in a task that searches it), arcs that are looked at together, and nodes
#: that are searched from together.
POINTS, TOGETHER, BLOCK = 65_536, 1_000_000, 128
#: Bytes of a graph beyond which it lies in a file of its process, which the system may page out, rather than in its memory.
MAPPED = 64_000_000
#: Nodes of a level that are tried first for the next one.
SPREAD = 128
EDGES = "src long, dst long, sx double, sy double, dx double, dy double, dist double"


def polygon(x: float, y: float, ends: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Angles and corners of the visibility polygon, as isovist.isovist_vertices has them. numpy's own sines can be a last digit off."""
    a = np.array([math.atan2(v, u) for u, v in zip((ends[:, 0] - x).tolist(), (ends[:, 1] - y).tolist(), strict=True)])
    a = np.unique(np.concatenate([a - g.SIDE, a, a + g.SIDE]))
    c, s = np.array([math.cos(v) for v in a.tolist()]), np.array([math.sin(v) for v in a.tolist()])
    ax, ay, bx, by = segments.T
    ex, ey, rx, ry = bx - ax, by - ay, ax - x, ay - y
    denom = ex * s[:, None] - ey * c[:, None]
    flat = np.abs(denom) < g.PARALLEL
    denom[flat] = 1.0
    t, u = (ex * ry - ey * rx) / denom, (c[:, None] * ry - s[:, None] * rx) / denom
    t[flat | (t < g.NEAR) | (u < -g.EDGE) | (u > 1.0 + g.EDGE)] = np.inf
    t = t.min(1, initial=np.inf)
    t[np.isinf(t)] = 0.0
    return a, x + c * t, y + s * t


def holds(x: float, y: float, shape: tuple[np.ndarray, np.ndarray, np.ndarray], px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Which points lie in the polygon about (x, y), by even-odd crossings."""
    angle, vx, vy = shape
    wx, wy = np.roll(vx, -1), np.roll(vy, -1)
    at = np.arctan2(py - y, px - x)
    k = np.searchsorted(angle, at)
    below, above = angle[k - 1], angle[np.minimum(k, len(angle) - 1)]  # k - 1 is the last one for those before the first
    i = np.where(k == 0, len(angle), k) - 1
    ax, ay = vx[i], vy[i]
    ex, ey = wx[i] - ax, wy[i] - ay
    side = ex * (py - ay) - ey * (px - ax)
    inside = side > 0
    size = 1.0 + max(np.abs(vx).max(), np.abs(vy).max())
    close = (np.abs(side) < 1e-11 * size * size) | (np.abs(at - below) < 1e-9) | (np.abs(at - above) < 1e-9) | (np.abs(at) > np.pi - 2 * g.SIDE) | ((px == x) & (py == y))
    for j in np.flatnonzero(close):
        pass_ = (wy > py[j]) != (vy > py[j])
        rise = np.where(pass_, vy - wy, 1.0)
        inside[j] = (pass_ & (px[j] < (vx - wx) * (py[j] - vy) / rise + vx)).sum() % 2 == 1
    return inside


class Bits:
    """A graph in which every arc goes both ways: nodes in the order of ids, rows[i] the neighbours of node i."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray, upper: list[bytes]):
        """upper: for each node its higher neighbours, packed, from the byte that holds the node itself on."""
        n = len(ids)
        self.ids, self.x, self.y = ids, x, y
        shape = (n, (n + 7) // 8)
        if n * n // 8 > MAPPED:
            with tempfile.TemporaryFile() as file:
                self.rows = np.memmap(file, np.uint8, "w+", shape=shape).view(np.ndarray)
        else:
            self.rows = np.zeros(shape, np.uint8)
        for i, part in enumerate(upper):
            self.rows[i, i >> 3 :] = np.frombuffer(part, np.uint8)
        for lo in range(0, n, 4096):  # the lower half: columns of the upper one
            for up in range(0, min(lo + 4096, n), 4096):
                cols = np.unpackbits(self.rows[up : min(up, lo) + 4096, lo >> 3 : (lo + 4096) >> 3], axis=1)[:, : n - lo]
                self.rows[lo : lo + 4096, up >> 3 : (up + 4096) >> 3] |= np.packbits(cols.T, axis=1)

    @classmethod
    def of(cls, held) -> Bits:
        """Those of a Sights' broadcast, which this process keeps no second copy of."""
        bits = cls(*held.value)
        if getattr(held, "_path", None):  # can be read again
            vars(held).pop("_value", None)
        return bits

    def place(self, node: int) -> int:
        i = int(np.searchsorted(self.ids, node))
        return i if i < len(self.ids) and self.ids[i] == node else -1

    def matrix(self, lo: int, hi: int) -> np.ndarray:
        """Rows lo : hi as 0 and 1."""
        return np.unpackbits(self.rows[lo:hi], axis=1, count=len(self.ids))

    def product(self, m: np.ndarray) -> np.ndarray:
        """m times the adjacency, by blocks of columns (both ways are the same)."""
        out = np.empty(m.shape)
        for k in range(0, len(self.ids), 512):
            np.matmul(m, self.matrix(k, k + 512).T.astype(np.float64), out=out[:, k : k + 512])
        return out

    def levels(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of some nodes a row of hops (-1: not reached) and of numbers of shortest paths."""
        depth, paths = np.full((len(at), len(self.ids)), -1, np.int32), np.zeros((len(at), len(self.ids)))
        me = np.arange(len(at))
        depth[me, at], paths[me, at], level = 0, 1.0, 1
        now = np.unpackbits(self.rows[at], axis=1, count=len(self.ids)).astype(np.float64)
        while (new := (now > 0) & (depth < 0)).any():
            depth[new], paths[new] = level, now[new]
            if (depth >= 0).all():
                break
            level, now = level + 1, self.product(np.where(new, now, 0.0))
        return depth, paths

    def dependencies(self, depth: np.ndarray, paths: np.ndarray) -> np.ndarray:
        """Brandes dependency of the nodes of `levels` on each node, from the deepest level up."""
        delta = np.zeros(depth.shape)
        for level in range(int(depth.max()), 0, -1):
            up = self.product(np.divide(1 + delta, paths, out=np.zeros(depth.shape), where=depth == level))
            np.multiply(paths, up, out=delta, where=depth == level - 1)
        return delta

    def hops(self, at: int) -> np.ndarray:
        """Hops from a node, -1 where it is not reached. A few nodes of a level, spread over all of it, reach most of the next one; those that are left then look
        for a neighbour in the level themselves, which is less to read."""
        n, level = len(self.ids), 0
        depth, front, done = np.full(n, -1, np.int32), np.array([at]), np.zeros(self.rows.shape[1], np.uint8)
        while len(front):
            depth[front] = level
            level, now = level + 1, np.zeros(n, np.uint8)
            now[front] = 1
            now = np.packbits(now)
            done |= now
            seen, k, size = done.copy(), 0, SPREAD
            order = front if len(front) <= size else np.concatenate([front[i :: -(-len(front) // size)] for i in range(-(-len(front) // size))])
            while len(left := np.flatnonzero(np.unpackbits(seen, count=n) == 0)) and k < len(front):
                if k and len(left) <= size or len(left) < size:
                    for some in (left[i : i + 128] for i in range(0, len(left), 128)):
                        depth[some[(self.rows[some] & now).any(1)]] = level
                    break
                for i in range(k, min(k + size, len(order)), 256):
                    seen |= np.bitwise_or.reduce(self.rows[order[i : min(i + 256, k + size)]], axis=0)
                k, size = k + size, 2 * size
            depth[np.flatnonzero(np.unpackbits(seen & ~done, count=n))] = level
            front = np.flatnonzero(depth == level)
        return depth

    def cheapest(self, start: int, price, to: int) -> tuple[np.ndarray, np.ndarray]:
        """Least cost from start and parent of each node that can lie on the cheapest way to `to`, with the rounds and ties of _local.Net.cheapest. price(a, b):
        of arcs between places, 0 or more; so what costs as much as the best way found leads to none that is better."""
        n = len(self.ids)
        cost, parent = np.full(n, np.inf), np.full(n, -1)
        cost[start], front = 0.0, np.array([start])
        step = max(1, TOGETHER // max(1, n))
        while len(front := front[(front != to) & (cost[front] < cost[to])]):
            old, kept = cost.copy(), []
            for k in range(0, len(front), step):
                part = front[k : k + step]
                who, b = np.nonzero(np.unpackbits(self.rows[part], axis=1, count=n) & (old[None, :] > old[part, None]))
                a = part[who]
                c = old[a] + price(a, b)
                better = (c < old[b]) & ((c < cost[to]) | (b == to))
                a, b, c = a[better], b[better], c[better]
                np.minimum.at(cost, b, c)
                won = c == cost[b]
                kept.append((a[won], b[won], c[won]))
            a, b, c = (np.concatenate(x) for x in zip(*kept, strict=True))
            won = c == cost[b]
            a, b = a[won], b[won]
            order = np.lexsort((a, b))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, int)
            front = b[first]
            parent[front] = a[first]
        return cost, parent

    def cheapest_back(self, to: int, price, extra) -> tuple[np.ndarray, np.ndarray]:
        """Least cost from each node to `to` and the sum of `extra` along that way, with the rounds and ties of _local.Net.cheapest, back. price(units, a, b) and extra(a, b): of
        arcs between places, 0 or more; units are what extra gives."""
        n = len(self.ids)
        cost, more = np.full(n, np.inf), np.zeros(n)
        cost[to], front = 0.0, np.array([to])
        step = max(1, TOGETHER // max(1, n))
        while len(front):
            new, parent, units_of = cost.copy(), np.full(n, -1), np.zeros(n)
            for k in range(0, len(front), step):
                part = front[k : k + step]
                who, a = np.nonzero(np.unpackbits(self.rows[part], axis=1, count=n) & (cost[None, :] > cost[part, None]))
                b = part[who]
                units = extra(a, b)
                c = cost[b] + price(units, a, b)
                better = np.flatnonzero(c < new[a])
                a, b, c, units = a[better], b[better], c[better], units[better]
                np.minimum.at(new, a, c)
                won = np.flatnonzero(c == new[a])[::-1]  # of one cost the first, which is of the least parent: they come in order
                parent[a[won]], units_of[a[won]] = b[won], units[won]
            front = np.flatnonzero(parent >= 0)
            cost[front], more[front] = new[front], more[parent[front]] + units_of[front]
        return cost, more


#: What this process made last of a broadcast.
_made: dict = {}


def once(key: str, make):
    """make(), or what it gave before in this process for the same key; a task that holds _made itself would bring a copy of its own."""
    if key not in _made:
        _made.clear()
        _made[key] = make()
    return _made[key]


class Sights:
    """The visibility graph of some viewpoints: rows (id, x, y, near), written, as bits; edges() its arcs."""

    def __init__(self, rows: DataFrame, ids: np.ndarray, x: np.ndarray, y: np.ndarray):
        self.rows, self.ids, self.x, self.y, self._sent = rows, ids, x, y, None

    def edges(self) -> DataFrame:
        """src, dst, sx, sy, dx, dy, dist in both directions, as graph.visibility_edges has them."""
        held = self.rows.sparkSession.sparkContext.broadcast((self.ids, self.x, self.y))
        names = [c.split()[0] for c in EDGES.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, x, y = held.value
                for k, near in zip(batch.column("place").to_pylist(), batch.column("near").to_pylist(), strict=True):
                    j = np.flatnonzero(np.unpackbits(np.frombuffer(near, np.uint8))) + (k >> 3) * 8
                    i = np.full(len(j), k)
                    a, b = np.concatenate([i, j]), np.concatenate([j, i])
                    ex, ey = x[b] - x[a], y[b] - y[a]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[a], ids[b], x[a], y[a], x[b], y[b], np.sqrt(ex * ex + ey * ey))], names=names)

        return self.rows.mapInArrow(run, EDGES)

    def count(self) -> int:
        """Arcs, both directions."""
        return 2 * sum(int(np.bitwise_count(np.frombuffer(part, np.uint8)).sum(dtype=np.int64)) for part in self.sent().value[3])

    def spread(self) -> bool:
        """Whether no two viewpoints lie so near each other that the way between them has no direction."""
        for k in range(4):  # such two share a cell of one of four grids
            cell = np.floor(self.x / (4 * g.TINY) + 0.5 * (k & 1)) + 1j * np.floor(self.y / (4 * g.TINY) + 0.5 * (k >> 1))
            if len(np.unique(cell)) < len(cell):
                return False
        return True

    def each(self, search, schema: str, rows: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
        """search(bits, places): columns for up to `block` nodes at once; rows: the nodes' ids (column id), all by default."""
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        spark, held, types = self.rows.sparkSession, self.sent(), to_arrow_schema(StructType.fromDDL(schema))
        rows = self.rows.select("place") if rows is None else rows.select("id")

        key = str(uuid.uuid4())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = once(key, lambda: Bits.of(held))
                got = batch.column(0).to_numpy()
                if batch.schema.names == ["id"]:
                    got = np.array([bits.place(v) for v in got.tolist()], np.int64)
                for k in range(0, len(got), block):
                    out = search(bits, got[k : k + block])
                    table = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in types], schema=types)
                    yield from (table.slice(i, 100_000) for i in range(0, len(table), 100_000))

        return rows.repartition(max(1, min(-(-len(self.ids) // 16), spark.sparkContext.defaultParallelism * 8))).mapInArrow(run, schema)

    def sent(self):
        """A broadcast of what Bits are made of."""
        if self._sent is None:
            parts, near = self.rows.select("place", "near").toArrow().to_batches(), [b""] * len(self.ids)
            while parts:  # held once only
                part = parts.pop()
                for k, bits in zip(part.column("place").to_pylist(), part.column("near").to_pylist(), strict=True):
                    near[k] = bits
            self._sent = self.rows.sparkSession.sparkContext.broadcast((self.ids, self.x, self.y, near))
        return self._sent


def sights(centres: DataFrame, segments: DataFrame) -> Sights | None:
    """The visibility graph as bits; None if the plan or the viewpoints are too many."""
    spark = centres.sparkSession
    if segments.limit(isovist.SEGMENTS + 1).count() > isovist.SEGMENTS or centres.limit(POINTS + 1).count() > POINTS:
        return None
    got = centres.select(F.col("id").cast("long").alias("id"), "x", "y").orderBy("id").toArrow()
    ids, x, y = (got.column(c).to_numpy() for c in ("id", "x", "y"))
    if len(np.unique(ids)) < len(ids):
        return None
    plan = np.array([list(r.values()) for r in segments.select("ax", "ay", "bx", "by").toArrow().to_pylist()], float).reshape(-1, 4)
    held = spark.sparkContext.broadcast((ids, x, y, plan))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x, y, plan = held.value
            ends = np.unique(np.concatenate([plan[:, :2], plan[:, 2:]]), axis=0)
            places = batch.column("place").to_numpy()
            for some in (places[k : k + 64] for k in range(0, len(places), 64)):
                near = []
                for k in some:
                    bits = np.zeros(len(ids) - (k >> 3) * 8, np.uint8)
                    if len(ends):
                        bits[k % 8 + 1 :] = holds(x[k], y[k], polygon(x[k], y[k], ends, plan), x[k + 1 :], y[k + 1 :])
                    near.append(np.packbits(bits).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(near, pa.binary())], names=["place", "near"])

    tasks = max(1, min(-(-len(ids) // 64), spark.sparkContext.defaultParallelism * 8))
    # Places dealt out in turn, as a low one has more to test than a high one.
    places = spark.range(0, len(ids), 1, tasks).select(F.col("id").alias("place")).repartition(tasks)
    return Sights(written(places.mapInArrow(run, "place long, near binary"), "sights"), ids, x, y)
