"""Searches from one node at a time, for graphs that fit in a task.

A graph of at most ARCS arcs (counted first) goes to the tasks as arrays; each task searches from its own anchors, so a measure over all pairs
needs no shuffle but that of its sums. Rounds and ties are those of `_loop.fixpoint`, which serves larger graphs: an equal cost of an earlier round stays,
within a round the least parent wins."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import TINY
from . import _polar, _turns
from .sights import Bits, Sights, once

#: Arcs of a graph that is sent to the tasks (about 60 bytes each), and steps from arc to arc that are looked at together. A graph that comes as bits is sent as
#: such and its arcs, of which there may be more, are listed in the task (24 bytes each).
ARCS, TOGETHER, FROM_BITS = 2_000_000, 2_000_000, 16_000_000
#: Arcs as bits whose ways of least turn are searched in a task, by bearing (80 bytes each).
FANNED = 8_000_000
#: Slack in radians for the rounding of bounds.
NEAR = 1e-6


def between(ax, ay, bx, by) -> np.ndarray:
    """Radians between vectors, 0 if either is (nearly) null."""
    ma, mb = np.sqrt(ax * ax + ay * ay), np.sqrt(bx * bx + by * by)
    flat = (ma < TINY) | (mb < TINY)
    return np.where(flat, 0.0, np.arccos(np.clip((ax * bx + ay * by) / np.where(flat, 1.0, ma * mb), -1.0, 1.0)))


class Net:
    """Arcs src-dst in order, as places in ids; out[i] : out[i + 1] are those that leave node i."""

    def __init__(self, src, dst, sx, sy, dx, dy, dist):
        self.ids, both = np.unique(np.concatenate([src, dst]), return_inverse=True)
        n = len(self.ids)
        s, d = both[: len(src)], both[len(src) :]
        self.x, self.y = np.zeros(n), np.zeros(n)
        self.x[s], self.y[s] = sx, sy
        self.x[d], self.y[d] = dx, dy
        order = np.lexsort((d, s))
        self.src, self.dst, self.dist = s[order].astype(np.int32), d[order].astype(np.int32), dist[order]
        self.out = np.searchsorted(self.src, np.arange(n + 1))
        self.back = np.argsort(self.dst, kind="stable").astype(np.int32)  # arcs by their end, then by their start
        self.into = np.searchsorted(self.dst[self.back], np.arange(n + 1))

    @classmethod
    def of(cls, bits: Bits) -> Net:
        new, n = cls.__new__(cls), len(bits.ids)
        new.ids, new.x, new.y = bits.ids, bits.x, bits.y
        near = [np.flatnonzero(bits.matrix(i, i + 1)[0]).astype(np.int32) for i in range(n)]
        new.out = np.append(0, np.cumsum([len(v) for v in near]))
        new.dst = np.concatenate([*near, np.zeros(0, np.int32)])
        new.src = np.repeat(np.arange(n, dtype=np.int32), np.diff(new.out))
        ex, ey = new.x[new.dst] - new.x[new.src], new.y[new.dst] - new.y[new.src]
        new.dist = np.sqrt(ex * ex + ey * ey)
        new.back, new.into = np.argsort(new.dst, kind="stable").astype(np.int32), new.out  # as many lead to a node as leave it
        return new

    @functools.cached_property
    def views(self) -> _polar.Views:
        return _polar.Views(self)

    @functools.cached_property
    def fan(self) -> _turns.Fan:
        return _turns.Fan(self)

    def place(self, node: int) -> int:
        i = int(np.searchsorted(self.ids, node))
        return i if i < len(self.ids) and self.ids[i] == node else -1

    @staticmethod
    def spans(ptr: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of `of` the places ptr[i] .. ptr[i + 1] - 1, and which of `of` each belongs to."""
        size = ptr[of + 1] - ptr[of]
        who = np.repeat(np.arange(len(of)), size)
        return np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ptr[of], size), who

    def levels(self, at: int) -> tuple[np.ndarray, np.ndarray, list]:
        """Hops (-1: not reached), numbers of shortest paths, and the arcs from each level to the next."""
        depth, paths, front, steps = np.full(len(self.ids), -1), np.zeros(len(self.ids)), np.array([at]), []
        depth[at], paths[at] = 0, 1.0
        while len(front):
            arcs, who = self.spans(self.out, front)
            a, b = front[who], self.dst[arcs]
            new = depth[b] < 0
            a, b = a[new], b[new]
            np.add.at(paths, b, paths[a])
            front = np.unique(b)
            depth[front] = len(steps) + 1
            steps.append((a, b))
        return depth, paths, steps

    def cheapest(self, start: int, costs: np.ndarray, to: int | None = None, back: bool = False, extra: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least cost from start to each node (back: from each node to start), its parent, and the sum of `extra` along that way. Not on from `to`."""
        n = len(self.ids)
        cost, parent, more = np.full(n, np.inf), np.full(n, -1), np.zeros(n)
        cost[start], front = 0.0, np.array([start])
        while len(front := front[front != to] if to is not None else front):
            arcs, who = self.spans(self.into if back else self.out, front)
            arcs = self.back[arcs] if back else arcs
            a, b = front[who], (self.src if back else self.dst)[arcs]
            c = cost[a] + costs[arcs]
            better = c < cost[b]
            arcs, a, b, c = arcs[better], a[better], b[better], c[better]
            np.minimum.at(cost, b, c)
            won = c == cost[b]
            arcs, a, b = arcs[won], a[won], b[won]
            order = np.lexsort((a, b))
            arcs, a, b = arcs[order], a[order], b[order]
            first = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, int)
            front = b[first]
            parent[front] = a[first]
            if extra is not None:
                more[front] = more[a[first]] + extra[arcs[first]]
        return cost, parent, more

    def cheapest_arcs(self, start: np.ndarray, first: np.ndarray, price: Callable, to: int | None = None, back: bool = False, low: np.ndarray | None = None, known: float = np.inf, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Least cost to each arc from the arcs in start, which cost `first`, and its parent arc. price(i, j): of the step from arc i to arc j, which
        begins where i ends and does not lead back (back: from arc j to arc i). Not on from arcs that end at `to`.
        low: of each arc, no more than what is left to pay from its end to `to`; arcs that cannot be on a way as cheap as the best one found or `known` are left out.
        only: the arcs that may be used."""
        cost, parent = np.full(len(self.src), np.inf), np.full(len(self.src), -1)
        cost[start], front = first, start
        ends, ptr = (self.src, self.into) if back else (self.dst, self.out)
        while len(front):
            if to is not None:
                front = front[self.dst[front] != to]
            most = np.inf
            if low is not None:
                most = min(known, cost[self.back[self.into[to] : self.into[to + 1]]].min(initial=np.inf)) + NEAR
                front = front[cost[front] + low[front] <= most]
            size = np.cumsum(ptr[ends[front] + 1] - ptr[ends[front]])
            cuts = np.searchsorted(size, np.arange(TOGETHER, (size[-1] if len(size) else 0) + TOGETHER, TOGETHER), "right")
            old, kept, begin = cost.copy(), [], 0
            for cut in [*cuts.tolist(), len(front)]:
                part = front[begin : max(cut, begin + 1)]
                begin += len(part)
                if not len(part):
                    continue
                on, who = self.spans(ptr, ends[part])
                on, i = (self.back[on] if back else on), part[who]
                ahead = (self.src[on] != self.dst[i]) if back else (self.dst[on] != self.src[i])
                if only is not None:
                    ahead &= only[on]
                on, i = on[ahead], i[ahead]
                if low is not None:
                    some = old[i] + low[on] <= most
                    on, i = on[some], i[some]
                c = old[i] + price(i, on)
                better = c < old[on] if low is None else (c < old[on]) & (c + low[on] <= most)
                on, i, c = on[better], i[better], c[better]
                np.minimum.at(cost, on, c)
                won = c == cost[on]
                kept.append((on[won], i[won], c[won]))
            if not kept:
                break
            on, i, c = (np.concatenate(x) for x in zip(*kept, strict=True))
            won = c == cost[on]
            on, i = on[won], i[won]
            order = np.lexsort((i, on))
            on, i = on[order], i[order]
            head = np.flatnonzero(np.append(True, on[1:] != on[:-1])) if len(on) else np.zeros(0, int)
            front = on[head]
            parent[front] = i[head]
        return cost, parent

    def least_parents(self, cost: np.ndarray, arcs: np.ndarray, price: Callable) -> np.ndarray:
        """For each of `arcs` the least arc before it that gives it its cost; -1 for others."""
        parent = np.full(len(self.src), -1)
        for k in range(0, len(arcs), 4096):
            part = arcs[k : k + 4096]
            on, who = self.spans(self.into, self.src[part])
            i, j = self.back[on], part[who]
            some = (self.src[i] != self.dst[j]) & np.isfinite(cost[i])
            i, j = i[some], j[some]
            same = cost[i] + price(i, j) == cost[j]
            i, j = i[same], j[same]
            order = np.lexsort((i, j))
            i, j = i[order], j[order]
            first = np.flatnonzero(np.append(True, j[1:] != j[:-1])) if len(j) else np.zeros(0, int)
            parent[j[first]] = i[first]
        return parent

    def turn(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Deviation from straight on between arc i and arc j, by the angle back."""
        return self.turn_way(self.src[i], self.dst[i], self.dst[j])

    def turn_way(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The turn of the way over three nodes."""
        x, y = self.x, self.y
        bx, by, cx, cy = x[c] - x[b], y[c] - y[b], x[a] - x[b], y[a] - y[b]
        flat = (np.sqrt(bx * bx + by * by) < TINY) | (np.sqrt(cx * cx + cy * cy) < TINY)
        return np.where(flat, 0.0, np.pi - between(bx, by, cx, cy))

    def heading(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.heading_way(self.src[i], self.dst[i], self.dst[j])

    def heading_way(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return between(self.x[b] - self.x[a], self.y[b] - self.y[a], self.x[c] - self.x[b], self.y[c] - self.y[b])

    def off_goal(self, arcs: np.ndarray | slice, gx: float, gy: float) -> np.ndarray:
        """Radians between each arc and the way from its start to the goal."""
        a, b = self.src[arcs], self.dst[arcs]
        return between(self.x[b] - self.x[a], self.y[b] - self.y[a], gx - self.x[a], gy - self.y[a])

    def some(self, a: np.ndarray, b: np.ndarray) -> Net:
        """The same nodes with the arcs a-b only, which come in order."""
        new = Net.__new__(Net)
        new.ids, new.x, new.y, new.src, new.dst = self.ids, self.x, self.y, a, b
        new.dist = np.sqrt((self.x[b] - self.x[a]) ** 2 + (self.y[b] - self.y[a]) ** 2)
        new.out, new.back = np.searchsorted(a, np.arange(len(self.ids) + 1)), np.argsort(b, kind="stable")
        new.into = np.searchsorted(b[new.back], np.arange(len(self.ids) + 1))
        return new

    def components(self) -> np.ndarray:
        """For each node the least place it reaches."""
        root = np.arange(len(self.ids))
        while True:
            low = np.minimum(root[self.src], root[self.dst])
            new = root.copy()
            np.minimum.at(new, root[self.src], low)
            np.minimum.at(new, root[self.dst], low)
            while (new != (up := new[new])).any():
                new = up
            if (new == root).all():
                return root
            root = new


def net(edges: DataFrame | Sights, arcs: int = ARCS, from_bits: int = FROM_BITS) -> Net | Sights | None:
    """The graph as `each` takes it if it has at most `arcs` arcs; as bits, from_bits."""
    if isinstance(edges, Sights):
        return edges if 0 < arcs and edges.count() <= from_bits else None
    if edges.limit(arcs + 1).count() > arcs:
        return None
    got = edges.select("src", "dst", "sx", "sy", "dx", "dy", "dist").toArrow()
    return Net(*(got.column(c).to_numpy() for c in ("src", "dst", "sx", "sy", "dx", "dy", "dist")))


def listed(edges: DataFrame | Sights) -> DataFrame:
    """The arcs as rows."""
    return edges.edges() if isinstance(edges, Sights) else edges


def each(rows: DataFrame, g: Net | Sights, search: Callable[[Net, dict], Iterator[dict[str, object]]], schema: str, bits: bool = False, near: bool = False) -> DataFrame:
    """near: rows (with x and y) that lie near each other come in turn. search(graph, row) for each row, spread over the tasks; it yields columns (arrays, or values that stand for all their rows). bits: the graph is
    a Bits."""
    spark = rows.sparkSession
    held, ready = (g.sent(), False) if isinstance(g, Sights) else (spark.sparkContext.broadcast(g), True)
    key = str(uuid.uuid4())
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                for out in search(once(key, lambda: held.value if ready else Bits.of(held) if bits else Net.of(Bits.of(held))), row):
                    n = next((len(v) for v in out.values() if isinstance(v, (list, np.ndarray))), 1)
                    yield pa.RecordBatch.from_arrays([pa.array(v if isinstance(v := out[f.name], (list, np.ndarray)) else [v] * n, f.type) for f in types], schema=types)

    tasks = spark.sparkContext.defaultParallelism * 4
    return (_by_place(rows, tasks) if near else rows.repartition(tasks)).mapInArrow(run, schema)


def _by_place(rows: DataFrame, tasks: int) -> DataFrame:
    low, high, n = rows.agg(F.min("x"), F.max("x"), F.count("*")).first()
    strip = F.floor((F.col("x") - F.lit(low)) / F.lit(max(2.0 * ((high or 0.0) - (low or 0.0)) / max(1.0, n**0.5), TINY)))
    return rows.repartitionByRange(tasks, strip, "y").sortWithinPartitions(strip, "y")
