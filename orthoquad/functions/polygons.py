"""Overlap of convex quadrilaterals as Column expressions.

Points are ARRAY<ARRAY<number>> in either sense of rotation, of any identity:
overlap does not depend on which corner is P0.  A quadrilateral that is null,
holds null or non-finite numbers, doesn't have four points, or isn't convex (a
corner turns the other way, or sides cross) has a null overlap.  One without
area overlaps nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import _col, corners_ok


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def _cross(a: Column, b: Column, p: Column) -> Column:
    """Twice the signed area of a, b, p; positive where they run clockwise in an image."""
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def area(points: Column) -> Column:
    """Signed area of any number of points, about the first, so that far ones don't lose digits."""
    turn = lambda p, i: _cross(points[0], p, points[F.pmod(i + 1, F.size(points))])
    total = F.aggregate(F.transform(points, turn), F.lit(0.0), lambda s, x: s + x) / 2
    return F.when(F.size(points) < 3, F.lit(0.0)).otherwise(total)


def is_convex(corners: Column | str) -> Column:
    """No corner turns against another, straight and repeated ones allowed; sides that cross turn both ways."""
    c = _col(corners)
    turns = [_cross(c[i], c[(i + 1) % 4], c[(i + 2) % 4]) for i in range(4)]
    return F.when(corners_ok(c), (F.least(*turns) >= 0) | (F.greatest(*turns) <= 0)).otherwise(F.lit(False))


def _clockwise(c: Column) -> Column:
    points = F.transform(c, lambda p: F.transform(p, lambda v: v.cast("double")))
    return _let(points, lambda x: F.when(area(x) < 0, F.reverse(x)).otherwise(x))


def _cut(polygon: Column, a: Column, b: Column) -> Column:
    """What of ``polygon`` lies on the right of a-b: its points there, and those where its sides pass the line."""

    def step(p: Column, i: Column) -> Column:
        q = polygon[F.pmod(i + 1, F.size(polygon))]
        both = F.array(_cross(a, b, p), _cross(a, b, q))

        def kept(s: Column) -> Column:
            share = s[0] / (s[0] - s[1])
            passing = F.array(p[0] + (q[0] - p[0]) * share, p[1] + (q[1] - p[1]) * share)
            none = F.slice(F.array(p), 1, 0)
            return F.when((s[0] >= 0) & (s[1] >= 0), F.array(q)).when(s[0] >= 0, F.array(passing)).when(s[1] >= 0, F.array(passing, q)).otherwise(none)

        return _let(both, kept)

    return F.flatten(F.transform(polygon, step))


def intersection_area(a: Column | str, b: Column | str) -> Column:
    """Area of what two convex quadrilaterals share: the first is cut by the sides of the second, one after another."""

    def clipped(x: Column, y: Column) -> Column:
        sides = F.sequence(F.lit(0), F.lit(3))
        cut = F.aggregate(sides, x, lambda poly, i: F.when(F.size(poly) == 0, poly).otherwise(_cut(poly, y[i], y[F.pmod(i + 1, F.lit(4))])))
        flat = (area(x) == 0) | (area(y) == 0)
        return F.when(flat, F.lit(0.0)).otherwise(_let(cut, lambda p: F.abs(area(p))))

    ca, cb = _col(a), _col(b)
    return F.when(is_convex(ca) & is_convex(cb), _let(_clockwise(ca), lambda x: _let(_clockwise(cb), lambda y: clipped(x, y))))


def polygon_iou(a: Column | str, b: Column | str) -> Column:
    """Intersection over union of two convex quadrilaterals; 0 where both have no area."""
    size = lambda c: F.abs(area(F.transform(_col(c), lambda p: F.transform(p, lambda v: v.cast("double")))))
    whole = F.struct(intersection_area(a, b).alias("i"), F.when(is_convex(a) & is_convex(b), size(a) + size(b)).alias("s"))
    return _let(whole, lambda w: F.when(w["i"].isNull(), F.lit(None).cast("double")).when(w["s"] > w["i"], w["i"] / (w["s"] - w["i"])).otherwise(F.lit(0.0)))
