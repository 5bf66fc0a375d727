"""Projective maps of ordered corners as Column expressions, in closed form.

A map is ARRAY<DOUBLE> of nine values, a 3x3 matrix by rows.  ``homography``
maps the code's own frame, in which P0 to P3 are (0, 0), (1, 0), (1, 1) and
(0, 1), to the image.  Quadrilaterals that are null, not four finite points, or
have three corners in a line have a null map, and points that a map sends to
infinity are null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import _col, corners_ok


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def homography(corners: Column | str) -> Column:
    """The map from the code's own frame to the image."""
    raw = _col(corners)

    def solved(c: Column) -> Column:
        x, y = [c[i][0] for i in range(4)], [c[i][1] for i in range(4)]
        turn = lambda i, j, k: (x[j] - x[i]) * (y[k] - y[i]) - (y[j] - y[i]) * (x[k] - x[i])
        flat = (turn(0, 1, 2) == 0) | (turn(1, 2, 3) == 0) | (turn(2, 3, 0) == 0) | (turn(3, 0, 1) == 0)
        ax, ay, bx, by = x[1] - x[2], y[1] - y[2], x[3] - x[2], y[3] - y[2]
        sx, sy = x[0] - x[1] + x[2] - x[3], y[0] - y[1] + y[2] - y[3]
        det = ax * by - bx * ay
        tilt = F.struct(((sx * by - bx * sy) / det).alias("g"), ((ax * sy - sx * ay) / det).alias("h"))
        matrix = lambda t: F.array(x[1] - x[0] + t["g"] * x[1], x[3] - x[0] + t["h"] * x[3], x[0], y[1] - y[0] + t["g"] * y[1], y[3] - y[0] + t["h"] * y[3], y[0], t["g"], t["h"], F.lit(1.0))
        return F.when(~flat, _let(F.when(~flat, tilt), matrix))

    points = F.transform(raw, lambda p: F.transform(p, lambda v: v.cast("double")))
    return F.when(corners_ok(raw), _let(F.when(corners_ok(raw), points), solved))


def inverse(matrix: Column | str) -> Column:
    """The map back, up to a factor, which does not matter."""

    def adjugate(m: Column) -> Column:
        minor = lambda a, b, c, d: m[a] * m[b] - m[c] * m[d]
        return F.when(m.isNotNull(), F.array(minor(4, 8, 5, 7), minor(2, 7, 1, 8), minor(1, 5, 2, 4), minor(5, 6, 3, 8), minor(0, 8, 2, 6), minor(2, 3, 0, 5), minor(3, 7, 4, 6), minor(1, 6, 0, 7), minor(0, 4, 1, 3)))

    return _let(_col(matrix), adjugate)


def project(matrix: Column | str, points: Column | str) -> Column:
    """Points under a map; null where one goes to infinity."""

    def moved(m: Column, p: Column) -> Column:
        depth = m[6] * p[0] + m[7] * p[1] + m[8]
        return _let(F.when(depth != 0, depth), lambda w: F.when(w.isNotNull(), F.array((m[0] * p[0] + m[1] * p[1] + m[2]) / w, (m[3] * p[0] + m[4] * p[1] + m[5]) / w)))

    return _let(_col(matrix), lambda m: F.when(m.isNotNull(), F.transform(_col(points), lambda p: moved(m, p))))


def frame_error(truth: Column | str, predicted: Column | str) -> Column:
    """Mean distance of corners of one identity in the truth's own frame, in sides of the code."""
    own = F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))))
    seen = project(inverse(homography(truth)), F.transform(_col(predicted), lambda p: F.transform(p, lambda v: v.cast("double"))))
    distance = F.zip_with(own, seen, lambda a, b: F.sqrt(F.pow(a[0] - b[0], 2) + F.pow(a[1] - b[1], 2)))
    return F.when(corners_ok(predicted), F.aggregate(distance, F.lit(0.0), lambda s, d: s + d) / 4)
