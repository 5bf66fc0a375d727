"""Dataset construction: validation, splits, names, constant fields, augmentation and evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..schema import CORNER_ORDER, LABEL, REJECT, SPLITS
from .numbering import number

FIELDS = ("image", "width", "height", "label", "corners", "corner_order")


def with_constants(df: DataFrame) -> DataFrame:
    return df.withColumns({"label": F.lit(LABEL), "corner_order": F.array(*map(F.lit, CORNER_ORDER))})


def reject_reason(shapes: str = "shapes") -> Column:
    """Null for exactly one polygon of four points, else why the row is rejected."""
    points = F.get(F.col(shapes), F.lit(0))["points"]
    return F.when(F.coalesce(F.size(shapes), F.lit(0)) != 1, "not one polygon").when(~g.corners_ok(points), "not four finite points")


def from_polygons(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations in click order, and rejects with their reason."""
    marked = rows.withColumn(REJECT, reject_reason())
    good = marked.where(F.col(REJECT).isNull()).select(F.col("imagePath").alias("image"), F.col("imageWidth").alias("width"), F.col("imageHeight").alias("height"), F.col("shapes")[0]["points"].alias("corners"))
    return with_constants(good).select(*FIELDS), marked.where(F.col(REJECT).isNotNull())


def assign_split(key: Column | str, train: int = 90, val: int = 5) -> Column:
    """Split by the first 32 bits of the MD5 of ``key`` as text, in hundredths; the rest is test."""
    own = F.col(key) if isinstance(key, str) else key
    bucket = F.conv(F.substring(F.md5(own.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < train, SPLITS[0]).when(bucket < train + val, SPLITS[1]).otherwise(SPLITS[2])


def image_name(split: Column | str, index: Column | str) -> Column:
    return F.format_string("images/%s_%07d.jpg", split, index)


def numbered_names(rows: DataFrame, order: Sequence[Column | str], split: str = "split") -> DataFrame:
    """``rows`` with ``index``, dense in each split along ``order``, and the name ``image`` that it makes."""
    return number(rows, order, [split]).withColumn("image", image_name(F.col(split), F.col("index")))


def stored(df: DataFrame) -> DataFrame:
    """The fields of a record; derived boxes are never stored."""
    return df.select(*FIELDS)


def turned(corners: Column, width: Column, height: Column, turns: Column) -> Column:
    """struct(c, w, h) after clockwise quarter turns (0 to 3)."""
    twice = F.transform(corners, lambda p: F.array(width - 1 - p[0], height - 1 - p[1]))
    once, thrice = g.rotate_points(corners, height), g.unrotate_points(corners, width)
    return F.when(turns == 1, g.frame(once, height, width)).when(turns == 2, g.frame(twice, width, height)).when(turns == 3, g.frame(thrice, height, width)).otherwise(g.frame(corners, width, height))


def turn(df: DataFrame, turns: Column | int, corners: str = "corners", width: str = "width", height: str = "height") -> DataFrame:
    """Augment by clockwise quarter turns; points keep their identity.  ``pixels.turn`` also turns the pixels."""
    t = F.pmod(turns if isinstance(turns, Column) else F.lit(turns), F.lit(4))
    return g.replace_frame(df, turned(F.col(corners), F.col(width), F.col(height), t), corners, width, height)


def evaluate(predicted: DataFrame, truth: DataFrame, key: str = "image") -> DataFrame:
    """Rows, rows found, and mean and greatest corner error and mean IoU of those found."""
    joined = truth.select(key, F.col("corners").alias("_t")).join(predicted.select(key, F.col("corners").alias("_p")), key, "left")
    error = g.corner_error("_t", "_p")
    overlap = g.iou(g.bbox("_t"), g.bbox("_p"))
    found = F.col("_p").isNotNull()
    return joined.agg(F.count("*").alias("n"), F.count_if(found).alias("n_found"), F.avg(F.when(found, error)).alias("mean_error"), F.max(F.when(found, error)).alias("max_error"), F.avg(F.when(found, overlap)).alias("mean_iou"))
