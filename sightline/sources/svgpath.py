"""The path language of SVG plans, as Arrow-batched column functions.

A table of operand counts drives the scan; a command repeats while numbers follow. Reading a plan keeps the first subpath; rewriting keeps all.
Malformed numbers (a lone sign or dot) end the path instead of failing the whole scan; so does a number behind a closed subpath when rewriting."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operands of each command. Fixed values.
OPERANDS = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}
PIECES, TOLERANCE = 8, 0.05
RUN = re.compile(r"[+-]?[0-9.]*(?:[eE][+-]?[0-9]*)?")
NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
GAP = re.compile(r"[ \t\n\r,]*")
RING = "array<struct<x:double,y:double>>"


def commands(d: str) -> Iterator[tuple[str, list[float]]]:
    """(letter, operands) of each step. After a moveto the letter is that of a lineto. Ends at malformed or missing operands, and
    at a Z that no letter follows."""
    at, letter = 0, ""
    while (at := GAP.match(d, at).end()) < len(d):
        fresh = d[at].isalpha() and d[at].isascii()
        if fresh:
            letter, at = d[at], at + 1
        need = OPERANDS.get(letter.upper())
        if need is None:
            at += 1  # the character behind an unknown letter
            continue
        if need == 0:
            if not fresh:
                return
            yield letter, []
            continue
        values: list[float] = []
        while len(values) < need:
            at = GAP.match(d, at).end()
            run = RUN.match(d, at)
            number = NUMBER.match(run[0])
            if not number:
                return
            values.append(float(number[0]))
            at = run.end()
        yield letter, values
        letter = {"M": "L", "m": "l"}.get(letter, letter)


def absolute(letter: str, v: list[float], x: float, y: float) -> list[tuple[float, float]]:
    """The step's points, from the pen at x, y; a relative letter adds the pen."""
    kind, (ox, oy) = letter.upper(), ((x, y) if letter.islower() else (0.0, 0.0))
    if kind == "H":
        return [(v[0] + ox, y)]
    if kind == "V":
        return [(x, v[0] + oy)]
    v = v[5:] if kind == "A" else v
    return [(v[i] + ox, v[i + 1] + oy) for i in range(0, len(v), 2)]


def bezier(p, a, b, q, pieces: int) -> list[tuple[float, float]]:
    out = []
    for k in range(1, pieces + 1):
        t = k / pieces
        w = ((1 - t) ** 3, 3 * (1 - t) ** 2 * t, 3 * (1 - t) * t**2, t**3)
        out.append(tuple(sum(c * z[i] for c, z in zip(w, (p, a, b, q), strict=True)) for i in (0, 1)))
    return out


def raised(p, c, q) -> tuple[tuple[float, float], tuple[float, float]]:
    """Cubic control points of a quadratic curve."""
    return tuple(p[i] + 2.0 / 3.0 * (c[i] - p[i]) for i in (0, 1)), tuple(q[i] + 2.0 / 3.0 * (c[i] - q[i]) for i in (0, 1))


def ring(d: str | None) -> list[tuple[float, float]]:
    """Vertices of the first subpath, curves as 8 samples; a last vertex equal to the first is dropped."""
    out: list[tuple[float, float]] = []
    pen = (0.0, 0.0)
    for letter, v in commands(d or ""):
        kind = letter.upper()
        if kind == "Z":
            break
        pts = absolute(letter, v, *pen)
        if kind == "C":
            out += bezier(pen, *pts, PIECES)
        elif kind == "S":  # the pen is the first control point
            out += bezier(pen, pen, *pts, PIECES)
        elif kind == "Q":
            out += bezier(pen, *raised(pen, *pts), pts[-1], PIECES)
        else:
            out.append(pts[-1])
        pen = pts[-1]
    return out[:-1] if len(out) > 1 and out[0] == out[-1] else out


def chord_distance(p, a, b) -> float:
    ex, ey = b[0] - a[0], b[1] - a[1]
    long2 = ex * ex + ey * ey
    t = 0.0 if long2 < 1e-18 else max(0.0, min(1.0, ((p[0] - a[0]) * ex + (p[1] - a[1]) * ey) / long2))
    return math.hypot(p[0] - a[0] - t * ex, p[1] - a[1] - t * ey)


def straight(d: str | None, pieces: int = PIECES, tolerance: float = TOLERANCE) -> tuple[str, int, int, int]:
    """The path as M, L and z with 3 decimals, and how many curves became one line, became pieces, and how many arcs became chords."""
    out: list[str] = []
    flat = cut = arcs = 0
    pen = start = (0.0, 0.0)
    last, control = "", pen  # the last step's kind and its last control point, for S and T
    for letter, v in commands(d or ""):
        kind = letter.upper()
        if kind == "Z":
            out.append("z")
            pen, last = start, kind
            continue
        pts = absolute(letter, v, *pen)
        curve = None
        if kind in "CS":
            a = pts[0] if kind == "C" else tuple(2 * pen[i] - control[i] for i in (0, 1)) if last in ("C", "S") else pen
            curve, control = (a, pts[-2]), pts[-2]
        elif kind in "QT":
            c = pts[0] if kind == "Q" else tuple(2 * pen[i] - control[i] for i in (0, 1)) if last in ("Q", "T") else pen
            curve, control = raised(pen, c, pts[-1]), c
        if curve is None:
            line = [pts[-1]]
            arcs += kind == "A"
        elif max(chord_distance(p, pen, pts[-1]) for p in curve) <= tolerance:
            line = [pts[-1]]
            flat += 1
        else:
            line = bezier(pen, *curve, pts[-1], pieces)
            cut += 1
        out += [f"{'M' if kind == 'M' else 'L'}{x:.3f},{y:.3f}" for x, y in line]
        pen = pts[-1]
        start = pen if kind == "M" else start
        last = kind
    return " ".join(out), flat, cut, arcs


def parse_path(d: Column) -> Column:
    @F.pandas_udf(RING)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"x": x, "y": y} for x, y in ring(t)])

    return run(d)


def simplify_path(d: Column, pieces: int = PIECES, tolerance: float = TOLERANCE) -> Column:
    """struct d, straightened, tessellated, arcs."""

    @F.pandas_udf("d string, straightened int, tessellated int, arcs int")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([straight(t, pieces, tolerance) for t in s], columns=["d", "straightened", "tessellated", "arcs"])

    return run(d)
