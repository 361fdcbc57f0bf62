"""Ways of least turn from one node to all others, in a graph of many arcs, without a cost for each arc.

A way that comes to a node with heading h at cost c serves nothing if another comes there with heading g at cost d and d + weight * |h - g| <= c: what follows costs the
other no more. A node that sees the start keeps the straight way only, since headings of a way that turns by t lie within t of the line between its ends. Of
the arcs that leave a node each is tried for the way that is cheapest in its direction. Costs are differences of bearings; the ways found are priced again as
`Net.turn`, `heading` and `off_goal` have it."""

from __future__ import annotations

import numpy as np

from ..functions.geometry import TINY

#: Arcs that are looked at together, ways that are held against each other together; what a way must be better by; slack of the bounds of a way's arcs.
BLOCK, MANY, LEAST, SLACK = 32_768, 60_000, 1e-12, 1e-8
#: Radians by which a way may turn more than the least and still come out as cheap in whole parts of 10^-9: half a part for each bend of both ways, and up to
#: 2 * 10^-8 for a bend that is nearly straight, whose cosine says no more.
TIED = 1e-6
#: Radians within which nodes lie in one line with the start.
LINE = 1e-7
ROUND = 2 * np.pi


class Fan:
    """Of a Net's arcs: those of each node by bearing."""

    def __init__(self, net):
        bearing = np.arctan2(net.y[net.dst] - net.y[net.src], net.x[net.dst] - net.x[net.src])
        order = np.lexsort((bearing, net.src))
        self.bearing, self.dst = bearing[order], net.dst[order].astype(np.intp)
        self.key = self.bearing + 8.0 * net.src  # in order over all arcs
        self.pair = net.src.astype(np.int64) * len(net.ids) + net.dst
        self.part = net.components()


def _apart(a: np.ndarray) -> np.ndarray:
    np.abs(a, out=a)
    return np.minimum(a, ROUND - a, out=a)


def price(net, paths: list[np.ndarray], at: int, weight: float) -> np.ndarray:
    """Turns of ways from `at`, each a column of places from its end back, -1 where it is over."""
    cost = np.zeros(len(paths[0]))
    for k in range(len(paths) - 2, -1, -1):
        some = np.flatnonzero(paths[k + 1] >= 0)
        start = paths[k + 2][some] if k + 2 < len(paths) else np.full(len(some), -1)
        cost[some] += weight * net.turn_way(np.where(start >= 0, start, at), paths[k + 1][some], paths[k][some])
    return cost


class _Ways:
    """Ways from `at`; of each node those that no other makes needless, in columns, the cheapest first."""

    def __init__(self, net, fan: Fan, at: int, weight: float, goal: bool, slack: float = SLACK):
        self.net, self.fan, self.at, self.weight, self.goal, self.slack = net, fan, at, weight, goal, slack
        n, near = len(net.ids), slice(int(net.out[at]), int(net.out[at + 1]))
        self.off = np.arctan2(net.y - net.y[at], net.x - net.x[at])
        self.flat = np.hypot(net.x - net.x[at], net.y - net.y[at]) < TINY
        node = fan.dst[near]
        # All ways: node, the way before (-1: none), heading, cost.
        self.node, self.before, self.head, self.cost = [node], [np.full(len(node), -1)], [fan.bearing[near]], [np.zeros(len(node))]
        self.size = len(node)
        self.heads, self.costs, self.which, self.held = np.zeros((1, n)), np.full((1, n), np.inf), np.full((1, n), -1), np.zeros(n, int)
        self.heads[0, node], self.costs[0, node], self.which[0, node] = self.head[0], -np.inf, np.arange(len(node))  # nothing is better than the straight way
        self.costs[0, at] = -np.inf
        self.open = np.flatnonzero((self.costs[0] > 0) & (fan.part == fan.part[at]))

    def better(self, d, h, c) -> np.ndarray:
        """Which of the ways to d no held one makes needless."""
        left = np.arange(len(d))
        for heads, costs in zip(self.heads, self.costs, strict=True):
            k = np.flatnonzero(c < costs.take(d) + self.weight * _apart(h - heads.take(d)) - LEAST)
            left, d, h, c = left[k], d[k], h[k], c[k]
        return left

    def hold(self, d, h, c, before) -> None:
        """Takes those in that are needed, the cheapest of each node first."""
        k = self.better(d, h, c)
        d, h, c, before = d[k], h[k], c[k], before[k]
        n = len(self.held)
        while len(d):
            least, one, head = np.full(n, np.inf), np.full(n, -1), np.zeros(n)
            np.minimum.at(least, d, c)
            won = np.flatnonzero(c == least[d])
            one[d[won]] = won
            some = np.flatnonzero(one >= 0)
            pick = one[some]
            new = np.arange(self.size, self.size + len(some))
            self.node.append(some), self.before.append(before[pick]), self.head.append(h[pick]), self.cost.append(c[pick])
            self.size += len(some)
            at = self.held[some]
            while at.max() >= len(self.heads):
                self.heads, self.costs, self.which = np.vstack([self.heads, np.zeros((1, n))]), np.vstack([self.costs, np.full((1, n), np.inf)]), np.vstack([self.which, np.full((1, n), -1)])
            self.heads[at, some], self.costs[at, some], self.which[at, some] = h[pick], c[pick], new
            self.held[some] += 1
            first = some[(at > 0) & (c[pick] < self.costs[0, some])]
            last = self.held[first] - 1
            for table in (self.heads, self.costs, self.which):
                table[0, first], table[last, first] = table[last, first], table[0, first]
            head[some] = h[pick]
            k = np.flatnonzero(c < least[d] + self.weight * _apart(h - head[d]) - LEAST)
            d, h, c, before = d[k], h[k], c[k], before[k]

    def sides(self, v, h, c) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How far to the left and right of its heading a way is the cheapest one, and whether it is at all."""
        right = np.minimum(np.pi, (self.costs[0][self.open].max(initial=-np.inf) - c) / self.weight)
        left, need = right.copy(), right > SLACK - self.slack
        for heads, costs in zip(self.heads, self.costs, strict=True):
            d, there = costs[v], heads[v]
            by = np.remainder(there - h, ROUND)
            near = np.minimum(by, ROUND - by)
            gap = np.where(np.isfinite(d) & ~((d == c) & (there == h)), d - c, np.inf) / self.weight
            need &= gap + near > -LEAST
            gap[gap >= near] = np.inf  # one that this way makes needless
            np.minimum(left, (by + gap) / 2, out=left)
            np.minimum(right, (ROUND - by + gap) / 2, out=right)
        return left + self.slack, right + self.slack, need

    def step(self, begin: int) -> None:
        """Tries the arcs on from the ways from `begin` on."""
        v, h, c = (np.concatenate(x)[begin:] for x in (self.node, self.head, self.cost))
        left, right, need = self.sides(v, h, c)
        i = np.flatnonzero(need)
        i = i[np.argsort(c[i], kind="stable")]  # the cheap first, as they make others needless
        lo, hi = h[i] - right[i], h[i] + left[i]
        # What passes the cut at half a turn is a span of its own.
        under, over = np.flatnonzero(lo < -np.pi), np.flatnonzero(hi > np.pi)
        lo = np.concatenate([np.maximum(lo, -np.pi), lo[under] + ROUND, np.full(len(over), -np.pi)]) - SLACK
        hi = np.concatenate([np.minimum(hi, np.pi), np.full(len(under), np.pi), hi[over] - ROUND]) + SLACK
        i = np.concatenate([i, i[under], i[over]])
        first, size = (x := np.searchsorted(self.fan.key, lo + 8.0 * v[i])), np.searchsorted(self.fan.key, hi + 8.0 * v[i]) - x
        i, first, size = i[size > 0], first[size > 0], size[size > 0]
        total, found, many = np.cumsum(size), [], 0
        cuts = np.unique(np.searchsorted(total, np.arange(BLOCK, (total[-1] if len(total) else 0), BLOCK)))
        for w, f, n in zip(np.split(i, cuts), np.split(first, cuts), np.split(size, cuts), strict=True):
            if not len(w):
                continue
            who = np.repeat(w, n)
            arcs = np.arange(len(who)) + np.repeat(f - (np.cumsum(n) - n), n)
            d, b = self.fan.dst[arcs], self.fan.bearing[arcs]
            cost = _apart(b - h[who])
            cost *= self.weight
            cost += c[who]
            if self.goal:
                more = _apart(b - self.off[d])
                more[self.flat[d]] = 0.0
                cost += more
            k = self.better(d, b, cost)
            found.append((d[k], b[k], cost[k], who[k] + begin))
            many += len(k)
            if many > MANY:
                self.hold(*(np.concatenate(x) for x in zip(*found, strict=True)))
                found, many = [], 0
        if many:
            self.hold(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _lines(net, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Arcs, as places, between nodes that lie in one line with `at`, towards it."""
    ex, ey = net.x - net.x[at], net.y - net.y[at]
    way = np.arctan2(ey, ex)
    way[way > np.pi - LINE] -= ROUND
    order = np.argsort(way)
    line = np.cumsum(np.diff(way[order], prepend=-4.0) > LINE)
    again = np.lexsort(((ex * ex + ey * ey)[order], line))
    order, line = order[again], line[again]
    a, b, k = [], [], 1
    while len(i := np.flatnonzero(line[k:] == line[:-k])):
        a.append(order[i + k]), b.append(order[i])
        k += 1
    if not a:
        return np.zeros(0, int), np.zeros(0, int)
    a, b = np.concatenate(a), np.concatenate(b)
    pair = a * len(net.ids) + b
    k = np.minimum(np.searchsorted(net.fan.pair, pair), len(net.fan.pair) - 1)
    some = net.fan.pair[k] == pair
    return a[some], b[some]


def search(net, at: int, weight: float = 1.0, goal: bool = False, slack: float = SLACK) -> _Ways:
    ways, done = _Ways(net, net.fan, at, weight, goal, slack), 0
    while done < ways.size:
        begin, done = done, ways.size
        ways.step(begin)
    return ways


def tied(ways: _Ways, slack: float = TIED) -> tuple[np.ndarray, np.ndarray]:
    """Arcs, as places in order, of all ways from the start that turn at most `slack` more than the least to their end. ways: found with that slack.

    The least turn to an arc is that of the held ways of its start. An arc is left out where a held way of its end turns less by more than the slack, whatever follows;
    then arcs are followed back from the last ones."""
    net, fan, at, n = ways.net, ways.fan, ways.at, len(ways.net.ids)
    heads, costs = ways.heads, np.where(np.isneginf(ways.costs), 0.0, ways.costs)
    costs[:, at] = np.inf
    # Held ways of all nodes by heading, each at what the others leave of its cost: of a heading in between the two beside it tell the least turn.
    r, v = np.nonzero(np.isfinite(costs))
    order = np.argsort(heads[r, v] + 8.0 * v)
    v, head, held = v[order], heads[r, v][order], costs[r, v][order]
    for some, there in zip(heads, costs, strict=True):
        held = np.minimum(held, there[v] + _apart(head - some[v]))
    key, own = head + 8.0 * v, np.searchsorted(v, np.arange(n + 1))

    def bound(node, h, place) -> np.ndarray:
        """Least turn to leave nodes, which hold ways, with heading h; place: the first way with a key of more."""
        lo, hi = own.take(node), own.take(node + 1)
        one, two = np.where(place > lo, place, hi) - 1, np.where(place < hi, place, lo)
        return np.minimum(held.take(one) + _apart(h - head.take(one)), held.take(two) + _apart(h - head.take(two)))

    place = np.repeat(np.arange(len(key) + 1, dtype=np.int32), np.diff(np.searchsorted(fan.key, key), prepend=0, append=len(fan.key)))
    least, first, empty = costs[0], heads[0], own[1:] == own[:-1]
    kept, found = [], []
    for begin in range(0, len(net.src) if len(key) else 0, BLOCK):
        part = slice(begin, begin + BLOCK)
        a, b, h = net.src[part], fan.dst[part], fan.bearing[part]
        cost = bound(np.where(empty.take(a), v[0], a), h, place[part])
        cost[empty.take(a)] = np.inf
        cost[a == at] = 0.0
        k = np.flatnonzero((cost <= least.take(b) + _apart(h - first.take(b)) + slack) & (cost < np.inf) & ~empty.take(b))
        k = k[cost[k] <= bound(b[k], h[k], np.searchsorted(key, h[k] + 8.0 * b[k])) + slack]
        kept.append(k + begin), found.append(cost[k])
    if not kept:
        return np.zeros(0, int), np.zeros(0, int)
    k, cost = np.concatenate(kept), np.concatenate(found)
    order = np.argsort(fan.dst[k], kind="stable")
    k, cost = k[order], cost[order]
    a, b, h = net.src[k], fan.dst[k], fan.bearing[k]
    into = np.searchsorted(b, np.arange(n + 1))
    need = cost <= least[b] + slack
    front = np.flatnonzero(need)
    while len(front := front[a[front] != at]):
        found = []
        for part in np.array_split(front, -(-len(front) // 1024)):
            i, who = net.spans(into, a[part])
            j = part[who]
            found.append(i[(cost[i] + _apart(h[j] - h[i]) <= cost[j] + slack) & ~need[i]])
        front = np.unique(np.concatenate(found))
        need[front] = True
    pair = np.unique(a[need].astype(np.int64) * n + b[need])
    return pair // n, pair % n


def passed(graph, at: int, whole: float) -> np.ndarray:
    """How often each node lies between the ends of the ways of least turn from `at` to all others, in whole parts of a radian; of last arcs and parents of one
    cost the least. graph: a Net whose arcs are all that may be on such ways."""
    start = np.arange(graph.out[at], graph.out[at + 1])
    price = lambda i, j: np.rint(graph.turn(i, j) * whole)
    cost, _ = graph.cheapest_arcs(start, np.zeros(len(start)), price)
    got = np.flatnonzero(np.isfinite(cost))
    parent = graph.least_parents(cost, got[graph.src[got] != at], price)
    got = got[graph.dst[got] != at]
    got = got[np.lexsort((graph.src[got], cost[got], graph.dst[got]))]
    arcs = got[np.append(True, graph.dst[got][1:] != graph.dst[got][:-1])] if len(got) else got
    out, n = np.zeros(len(graph.ids)), np.ones(len(arcs))
    while len(some := np.flatnonzero(parent[arcs] >= 0)):
        arcs, n = arcs[some], n[some]
        np.add.at(out, graph.src[arcs], n)
        arcs, which = np.unique(parent[arcs], return_inverse=True)
        n = np.bincount(which, n)
    return out


def least(net, at: int, weight: float = 1.0, goal: bool = False, ways: _Ways | None = None) -> np.ndarray:
    """Radians of least cost from each node to `at`, infinite where there is no way. goal: each arc costs its angle to the line from its start to `at` as
    well (prospect, from the nodes to `at`); otherwise turns alone, the first hop free (from `at` to the nodes, or back). weight > 0; no arc of no length. ways: if searched already."""
    ways = search(net, at, weight, goal) if ways is None else ways
    node, before = np.concatenate(ways.node), np.concatenate(ways.before)
    out = np.full(len(net.ids), np.inf)
    some = np.flatnonzero(ways.which[0] >= 0)
    way, paths = ways.which[0, some], [some]
    while ((way := np.where(way >= 0, before[way], -1)) >= 0).any():
        paths.append(np.where(way >= 0, node[way], -1))
    if not goal:
        out[some] = price(net, paths, at, weight)
        out[at] = 0.0
        return out
    # A line is never quite straight in plain arithmetic: over a node on it the same way can cost 10^-8 less. So the ways' arcs and those of lines to
    # the goal are searched in full.
    paths.append(np.full(len(some), -1))
    a, b = zip(*((p[p >= 0], np.where(q >= 0, q, at)[p >= 0]) for p, q in zip(paths, paths[1:], strict=False)), strict=True)
    more = _lines(net, at)
    pair = np.unique(np.concatenate([*a, more[0]]) * len(net.ids) + np.concatenate([*b, more[1]]))
    small = net.some(pair // len(net.ids), pair % len(net.ids))
    off = small.off_goal(slice(None), net.x[at], net.y[at])
    start = small.back[small.into[at] : small.into[at + 1]]
    cost, _ = small.cheapest_arcs(start, np.zeros(len(start)), lambda i, j: off[i] + weight * small.heading(j, i), back=True)
    np.minimum.at(out, small.src, cost + off)
    out[at] = 0.0
    return out
