"""Row-local expressions over points, segments and arcs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 6) -> Column:
    """Half-even rounding without a negative zero."""
    return F.bround(x, digits) + F.lit(0.0)


def dist(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(bx - ax, by - ay)


def sweep(a0: Column, a1: Column) -> Column:
    """Counter-clockwise angle from a0 to a1 in (0, 2*pi]; equal angles turn fully."""
    turn = F.pmod(a1 - a0, 2 * F.pi())
    return F.when(turn < 1e-12, 2 * F.pi()).otherwise(turn)


def bulge_arc(x0: Column, y0: Column, x1: Column, y1: Column, b: Column) -> dict[str, Column]:
    """Center, radius and direction of the arc that a bulge makes of a chord."""
    chord = dist(x0, y0, x1, y1)
    off = (1 - b * b) / (4 * b)
    return {
        "cx": (x0 + x1) / 2 - off * (y1 - y0),
        "cy": (y0 + y1) / 2 + off * (x1 - x0),
        "radius": chord * (1 + b * b) / (4 * F.abs(b)),
        "ccw": b > 0,
    }


def arc_angles(x0: Column, y0: Column, x1: Column, y1: Column, cx: Column, cy: Column, ccw: Column) -> tuple[Column, Column]:
    """(start angle, signed sweep) of an arc run from its first to its second end."""
    a0, a1 = F.atan2(y0 - cy, x0 - cx), F.atan2(y1 - cy, x1 - cx)
    return a0, F.when(ccw, sweep(a0, a1)).otherwise(-sweep(a1, a0))


def arc_steps(turn: Column, radius: Column, tolerance: float) -> Column:
    """Chords that keep an arc within ``tolerance``."""
    tol = F.least(F.lit(tolerance), 0.999 * radius)
    return F.greatest(F.lit(1), F.ceil(F.abs(turn) / (2 * F.acos(1 - tol / radius))).cast("int"))


def circle_3pt(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> dict[str, Column]:
    """Circumcircle; null for collinear points."""
    det = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    flat = F.abs(det) < 1e-9
    safe = F.when(flat, None).otherwise(det)
    a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    ux = (a2 * (by - cy) + b2 * (cy - ay) + c2 * (ay - by)) / safe
    uy = (a2 * (cx - bx) + b2 * (ax - cx) + c2 * (bx - ax)) / safe
    return {"ux": ux, "uy": uy, "radius": F.hypot(ax - ux, ay - uy)}


def segment_key(sx: Column, sy: Column, ex: Column, ey: Column) -> Column:
    """The same for a line in either direction."""
    a = F.struct(rounded(sx).alias("x"), rounded(sy).alias("y"))
    b = F.struct(rounded(ex).alias("x"), rounded(ey).alias("y"))
    return F.struct(F.least(a, b).alias("p"), F.greatest(a, b).alias("q"))


def circle_center(suu, svv, suv, su, sv, divide=lambda a, b: a / b):
    """Offset (a, b) of the least-squares circle's center from the mean of its points, by
    the normal equations of sums about that mean: of squares, products, and su, sv of
    each coordinate times the squared distance. For numbers and columns."""
    det = 2 * (suu * svv - suv * suv)
    return divide(su * svv - sv * suv, det), divide(sv * suu - su * suv, det)
