"""Column functions on ordered corners.

A quadrilateral is ARRAY<ARRAY<number>> of four [x, y] points, or the same flat.
No function reorders points: P0 stays P0 wherever it lies in the image.  Frames
use pixel indices, so a point (x, y) of a frame of height h lands at
(h - 1 - y, x) after a clockwise quarter turn.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_landscape(width: Column | str, height: Column | str) -> Column:
    """Strictly wider than high; square frames stay."""
    return _col(width) > _col(height)


def rotate_points(corners: Column | str, old_height: Column | str) -> Column:
    h = _col(old_height)
    return F.transform(_col(corners), lambda p: F.array(h - 1 - p[1], p[0]))


def unrotate_points(corners: Column | str, old_height: Column | str) -> Column:
    """The inverse of ``rotate_points``."""
    h = _col(old_height)
    return F.transform(_col(corners), lambda p: F.array(p[1], h - 1 - p[0]))


def replace_frame(df: DataFrame, frame: Column, corners: str, width: str, height: str) -> DataFrame:
    """Set corners, width and height at once from a struct (c, w, h) over the old ones.

    Columns set side by side may be resolved against each other's new values.
    """
    kept = df.columns
    return df.withColumn("_frame", frame).withColumn(corners, F.col("_frame.c")).withColumn(width, F.col("_frame.w")).withColumn(height, F.col("_frame.h")).select(*(f"`{c}`" for c in kept))


def frame(corners: Column, width: Column, height: Column) -> Column:
    return F.struct(corners.alias("c"), width.alias("w"), height.alias("h"))


def to_portrait(df: DataFrame, corners: str = "corners", width: str = "width", height: str = "height") -> DataFrame:
    """Rotate landscape rows: points by the old height, and the frame with them."""
    c, w, h = F.col(corners), F.col(width), F.col(height)
    turned = F.when(is_landscape(w, h), frame(rotate_points(c, h), h, w)).otherwise(frame(c, w, h))
    return replace_frame(df, turned, corners, width, height)


def resize_points(corners: Column | str, width: Column | str, height: Column | str, to_width: int, to_height: int) -> Column:
    """Points of a frame stretched to another size; frames must not be empty."""
    sx, sy = F.lit(float(to_width)) / _col(width), F.lit(float(to_height)) / _col(height)
    return F.transform(_col(corners), lambda p: F.array(p[0] * sx, p[1] * sy))


def flatten_corners(corners: Column | str) -> Column:
    return F.flatten(_col(corners))


def reshape_corners(flat: Column | str, offset: int = 0) -> Column:
    """Four points from eight consecutive values that start at ``offset``; null where the array is too short."""
    f = _col(flat)
    return F.when(F.size(f) >= offset + 8, F.array(*(F.array(F.get(f, F.lit(offset + 2 * i)), F.get(f, F.lit(offset + 2 * i + 1))) for i in range(4))))


def bbox(corners: Column | str) -> Column:
    """struct(x0, y0, x1, y1) of least and greatest coordinates; never stored with annotations."""
    c = _col(corners)
    of = lambda i: F.transform(c, lambda p: p[i])
    return F.struct(F.array_min(of(0)).alias("x0"), F.array_min(of(1)).alias("y0"), F.array_max(of(0)).alias("x1"), F.array_max(of(1)).alias("y1"))


def box_area(box: Column | str) -> Column:
    b = _col(box)
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def intersection(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    side = lambda low, high: F.greatest(F.least(a[high], b[high]) - F.greatest(a[low], b[low]), F.lit(0))
    return side("x0", "x1") * side("y0", "y1")


def iou(a: Column | str, b: Column | str) -> Column:
    """Intersection over union; 0 where both boxes are empty."""
    i = intersection(a, b)
    union = box_area(a) + box_area(b) - i
    return F.when(union > 0, i / union).otherwise(F.lit(0.0))


def signed_area(corners: Column | str) -> Column:
    """Shoelace area: positive where P0..P3 run clockwise in an image."""
    c = _col(corners)
    return reduce(lambda x, y: x + y, (c[i][0] * c[(i + 1) % 4][1] - c[(i + 1) % 4][0] * c[i][1] for i in range(4))) / 2


def direction(corners: Column | str) -> Column:
    """Angle of the side P0-P1 in radians."""
    c = _col(corners)
    return F.atan2(c[1][1] - c[0][1], c[1][0] - c[0][0])


def corner_error(a: Column | str, b: Column | str) -> Column:
    """Mean distance of corners of the same identity."""
    a, b = _col(a), _col(b)
    return reduce(lambda x, y: x + y, (F.sqrt(F.pow(a[i][0] - b[i][0], 2) + F.pow(a[i][1] - b[i][1], 2)) for i in range(4))) / 4


def corners_ok(corners: Column | str) -> Column:
    """Four points of two finite numbers each."""
    c = _col(corners)
    finite = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))
    return F.coalesce((F.size(c) == 4) & F.forall(c, lambda p: (F.size(p) == 2) & F.forall(p, finite)), F.lit(False))
