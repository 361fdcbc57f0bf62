"""Planar geometry as column expressions. All stay inside generated code; denominators are guarded, cosines clamped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ray and segment tolerances, and the angle added on either side of a vertex. Fixed values.
PARALLEL, NEAR, EDGE, SIDE, TINY = 1e-12, 1e-9, 1e-9, 1e-6, 1e-12


def distance(ax, ay, bx, by) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def angle_between(ax, ay, bx, by) -> Column:
    """Radians between two vectors, 0 if either is (nearly) null."""
    ma, mb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    flat = (ma < TINY) | (mb < TINY)
    cos = (ax * bx + ay * by) / F.when(flat, F.lit(1.0)).otherwise(ma * mb)
    return F.when(flat, F.lit(0.0)).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def turn(px, py, ax, ay, vx, vy) -> Column:
    """Deviation in radians at a, coming from p and going to v: 0 is straight on."""
    bx, by, cx, cy = vx - ax, vy - ay, px - ax, py - ay
    flat = (F.sqrt(bx * bx + by * by) < TINY) | (F.sqrt(cx * cx + cy * cy) < TINY)
    return F.when(flat, F.lit(0.0)).otherwise(F.pi() - angle_between(bx, by, cx, cy))


def goal_units(ax, ay, bx, by, dx, dy) -> Column:
    """Angle at a between the ways to b and to the goal d, in units of a right angle (0 to 2)."""
    return angle_between(dx - ax, dy - ay, bx - ax, by - ay) * (180.0 / F.pi()) / 90.0


def polar_cost(units: Column, length: Column, gamma) -> Column:
    """units ** gamma * length; with gamma 0 the length."""
    return F.pow(units, F.lit(gamma) if not isinstance(gamma, Column) else gamma) * length


def ray_hit(ox, oy, angle, ax, ay, bx, by) -> Column:
    """How far along the ray the segment a-b is; null if it is missed."""
    c, s = F.cos(angle), F.sin(angle)
    ex, ey, rx, ry = bx - ax, by - ay, ax - ox, ay - oy
    denom = ex * s - ey * c
    safe = F.when(F.abs(denom) < PARALLEL, F.lit(1.0)).otherwise(denom)
    t, u = (ex * ry - ey * rx) / safe, (c * ry - s * rx) / safe
    return F.when((F.abs(denom) >= PARALLEL) & (t >= NEAR) & (u >= -EDGE) & (u <= 1.0 + EDGE), t)


def straddles(y, ay, by) -> Column:
    """Whether the edge a-b passes the height y (half-open)."""
    return (by > y) != (ay > y)


def crosses(x, y, ax, ay, bx, by) -> Column:
    """Whether the edge a-b crosses the ray from (x, y) to the right; odd counts mean inside."""
    rise = F.when(straddles(y, ay, by), ay - by).otherwise(F.lit(1.0))
    return straddles(y, ay, by) & (x < (ax - bx) * (y - by) / rise + bx)


def chord_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance of p to the segment a-b; to a if the segment is a point."""
    ex, ey = bx - ax, by - ay
    long2 = ex * ex + ey * ey
    safe = F.when(long2 < 1e-18, F.lit(1.0)).otherwise(long2)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * ex + (py - ay) * ey) / safe))
    t = F.when(long2 < 1e-18, F.lit(0.0)).otherwise(t)
    return distance(px, py, ax + t * ex, ay + t * ey)


def dot_radius(area, n) -> Column:
    return F.sqrt(0.5 * area / n)
